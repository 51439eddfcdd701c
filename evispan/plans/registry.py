"""Every registered query by name, with its checking SQL where there is one."""

from evispan.plans import q_eval, q_graph, q_lexical, q_rank, q_select, q_text

FLAGSHIP = "select_rank"
QUERIES, ORACLES = {}, {}
for _family in (q_text, q_lexical, q_select, q_graph, q_rank, q_eval):
    QUERIES |= _family.QUERIES
    ORACLES |= _family.ORACLES
