"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.grulm import op9_grulm
from quillon.llm.langid import op5_langid
from quillon.llm.licenses import op7_licenses
from quillon.llm.linededup import op2_linededup
from quillon.llm.mixing import OP10_SQL, op10_mixing
from quillon.llm.packing import op4_packing
from quillon.llm.quality import op8_quality
from quillon.llm.simhash import op6_simhash
from quillon.llm.vafile import OP3_SQL, op3_vafile
from quillon.llm.warc import OP1_SQL, op1_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc, op2_linededup, op3_vafile, op4_packing, op5_langid, op6_simhash, op7_licenses, op8_quality, op9_grulm, op10_mixing)}
SQL = {"op1_warc": OP1_SQL, "op3_vafile": OP3_SQL, "op10_mixing": OP10_SQL}
