"""Every query with its SQL (none where SQL can't express it)."""

from . import cascade, graph, match, models, reports, votes, words

ALL = {**words.QUERIES, **match.QUERIES, **votes.QUERIES, **cascade.QUERIES, **graph.QUERIES, **reports.QUERIES, **models.QUERIES}
