"""The registered queries of the corpus operators, one module each."""

from weir.llm import bpe_query, embedding_query, html_query, jaccard_query, license_query, line_query, packing_query, quality_query, shard_query, suffix_query

MODULES = (bpe_query, quality_query, license_query, jaccard_query, embedding_query, suffix_query, line_query, shard_query, html_query, packing_query)

QUERIES = {m.NAME: m.query for m in MODULES}
ORACLE_SQL = {m.NAME: m.SQL for m in MODULES if m.SQL}
