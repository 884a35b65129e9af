"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.ann import op4_nearest
from millrace.llm.bpe import op6_bpe
from millrace.llm.dartminhash import op3_near_duplicates
from millrace.llm.decontam import op7_decontamination
from millrace.llm.fillmiddle import OP12_SQL, op12_fill_in_middle
from millrace.llm.langid import op8_language_id
from millrace.llm.linededup import OP13_SQL, op13_line_dedup
from millrace.llm.quality import op10_quality
from millrace.llm.secrets import op9_secrets
from millrace.llm.tokencount import op5_token_counts
from millrace.llm.urlfilter import OP2_SQL, op2_url_filter
from millrace.llm.warc import OP1_SQL, op1_warc
from millrace.llm.whitening import op11_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_url_filter, op3_near_duplicates, op4_nearest, op5_token_counts, op6_bpe, op7_decontamination, op8_language_id, op9_secrets, op10_quality, op11_whitening, op12_fill_in_middle, op13_line_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op2_url_filter": OP2_SQL, "op12_fill_in_middle": OP12_SQL, "op13_line_dedup": OP13_SQL}
