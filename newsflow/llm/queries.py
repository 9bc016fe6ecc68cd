"""One query per operator over its whole table, and SQL for those that SQL can express."""

from newsflow.llm.bpe import op2_bpe
from newsflow.llm.centroids import OP12_SQL, op12_ptolemaic_clusters
from newsflow.llm.chat import OP6_SQL, op6_chat_formatting
from newsflow.llm.graph_ann import op7_graph_neighbours
from newsflow.llm.lang_id import op8_language_id
from newsflow.llm.lexical import OP13_SQL, op13_dual_tree_search
from newsflow.llm.line_crf import op4_quality_classifier
from newsflow.llm.near_dedup import OP10_SQL, op10_minhash_near_dedup
from newsflow.llm.packing import op5_best_fit_packing
from newsflow.llm.repetition import op1_quality_rules
from newsflow.llm.suffix_dedup import op3_suffix_dedup
from newsflow.llm.token_store import op11_direct_codes
from newsflow.llm.urls import OP9_SQL, op9_url_filters

QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_bpe, op3_suffix_dedup, op4_quality_classifier, op5_best_fit_packing,
    op6_chat_formatting, op7_graph_neighbours, op8_language_id, op9_url_filters,
    op10_minhash_near_dedup, op11_direct_codes, op12_ptolemaic_clusters, op13_dual_tree_search)}
ORACLE = {"op6_chat_formatting": OP6_SQL, "op9_url_filters": OP9_SQL,
          "op10_minhash_near_dedup": OP10_SQL, "op12_ptolemaic_clusters": OP12_SQL,
          "op13_dual_tree_search": OP13_SQL}
