"""A training corpus in four stages: quality rules, toxicity, near-duplicates, packing. Part of quern.llm.

Each stage gets what the one before kept, written and read again; all but the last return the columns of documents. SQL can't
express the robust estimates or the classifier, so there is none; the stages are tested one by one, against brute force where there
is one (statistics, estimates, the risk and its gradient, all pairs, optimal bounds), and on odd cases.

Defined cases, as the stages have them: null, empty and short texts go with the quality rules; texts of which toxicity knows nothing
stay; rows without a doc_id are documents of their own; repeated rows end as one; very long texts are handled whole and packed in
windows; further columns go along to the last stage, whatever their names. An empty table: an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import minhash, packing, quality, toxicity
from quern.llm.common import table, written

STAGES = [
    ("quality rules", quality.stage),
    ("toxicity", toxicity.stage),
    ("near-duplicates", minhash.stage),
    ("packing", packing.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
