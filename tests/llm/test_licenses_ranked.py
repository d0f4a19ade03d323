"""an exact notice is chosen by what its template saves of the span; the words only confirm it."""

import pytest

from loam.llm import licenses


@pytest.fixture(autouse=True)
def fresh():
    yield
    licenses.judge.cache_clear()
    licenses.rejected.cache_clear()


def got(text):
    licenses.judge.cache_clear()
    licenses.rejected.cache_clear()
    return [(r[2], r[3], r[7]) for r in licenses.notices(text)]


def test_without_gain_nothing_is_exact(monkeypatch):
    text = "Released under the MIT License.\n"
    assert [r[2] for r in got(text)] == ["exact"]
    monkeypatch.setattr(licenses, "_size", lambda text, dictionary=None: len(text.encode()))
    assert [r[2] for r in got(text)] == ["rejected"]


def test_what_saves_more_wins(monkeypatch):
    long, short = licenses.TEMPLATES[3][1], licenses.TEMPLATES[2][1]
    assert " ".join(licenses._KNOWN[2][1]) in " ".join(licenses._KNOWN[3][1])
    assert (3, "exact") in [r[1:] for r in got(long)]
    size = licenses._size
    monkeypatch.setattr(licenses, "_size", lambda text, d=None: 1 if d and d.lower() == short.lower() else size(text) if d else size(text))
    assert (2, "exact") in [r[1:] for r in got(long)] and (3, "exact") not in [r[1:] for r in got(long)]


def test_every_wording_in_any_case():
    for i, (_, t) in enumerate(licenses.TEMPLATES + licenses.TITLES):
        for x in (t, t.upper(), t.lower()):
            saved, gain = licenses._saved(x, i)
            assert saved > 0 and gain >= licenses.GAIN, (i, gain)


def test_spans_in_one_another():
    assert licenses._ranked([(5, 0.5, 0, 9, 1), (9, 0.5, 0, 3, 2), (4, 0.5, 2, 12, 3), (8, 0.1, 20, 30, 4), (3, 0.5, 13, 15, 5)]) == [(0, 3, 2), (2, 12, 3), (13, 15, 5)]
