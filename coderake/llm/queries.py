"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from coderake.llm.chat import OP7_SQL, op7_chat_format
from coderake.llm.mixing import op1_source_mixing
from coderake.llm.packing import op3_best_fit_packing
from coderake.llm.warc import OP9_SQL, op9_warc_revisit

QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op7_chat_format": op7_chat_format,
    "op9_warc_revisit": op9_warc_revisit,
}

ORACLE_SQL = {"op7_chat_format": OP7_SQL, "op9_warc_revisit": OP9_SQL}

from coderake.llm.ngram_join import OP5_SQL, op5_ngram_jaccard  # noqa: E402

QUERIES["op5_ngram_jaccard"] = op5_ngram_jaccard
ORACLE_SQL["op5_ngram_jaccard"] = OP5_SQL

from coderake.llm.langid import op6_language_ecoc  # noqa: E402
from coderake.llm.quality import op4_quality_pu  # noqa: E402

QUERIES |= {"op4_quality_pu": op4_quality_pu, "op6_language_ecoc": op6_language_ecoc}

from coderake.llm.ball_tree import OP10_SQL, op10_ball_tree_topk  # noqa: E402

QUERIES["op10_ball_tree_topk"] = op10_ball_tree_topk
ORACLE_SQL["op10_ball_tree_topk"] = OP10_SQL

from coderake.llm.kmeans_tree import op2_kmeans_tree_ann  # noqa: E402

QUERIES["op2_kmeans_tree_ann"] = op2_kmeans_tree_ann

from coderake.llm.token_counts import op8_token_counts  # noqa: E402

QUERIES["op8_token_counts"] = op8_token_counts

from coderake.llm.best_position import OP13_SQL, op13_best_position  # noqa: E402
from coderake.llm.fim import OP12_SQL, op12_fill_in_middle  # noqa: E402
from coderake.llm.golay import op11_simhash_golay  # noqa: E402

QUERIES |= {"op11_simhash_golay": op11_simhash_golay, "op12_fill_in_middle": op12_fill_in_middle, "op13_best_position": op13_best_position}
ORACLE_SQL |= {"op12_fill_in_middle": OP12_SQL, "op13_best_position": OP13_SQL}
