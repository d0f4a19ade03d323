"""One registered query for each operator; importing the package registers them all."""

from loam.plans import chats, evaluation, graph, maintenance, monitoring, notes, retrieval, screening, serving, topics  # noqa: F401
