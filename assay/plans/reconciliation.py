"""Evidence of stated cases as tables, for tests and trials of the reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assay.operators import reconcile as rc

#: (case, transcripts with confidences, existing record)
CASES = [
    (1, [("देहरादून", 0.80), ("देहरादुन", 0.70), ("देहरादून", 0.75), ("देरादून", 0.99)], None),
    (2, [("अल्मोड़ा", 0.9)] * 3 + [("अलमोरा", 0.9)] * 2, None),
    (3, [("कोटद्वार", 0.9)] * 3, ("कोटद्वारा", "Kotdwar")),
    (4, [("ईटानगर", 0.99)], None),
    (5, [("कर्ण प्रयाग", 0.9), ("कण प्रयाग", 0.9), ("कर्ण प्रयाग", 0.9), ("करण प्रयाग", 0.9)], ("कर्णप्रयाग", "Karnaprayag")),
    (6, [("", 0.9)], None),
]


def evidence(spark: SparkSession, cases=CASES) -> DataFrame:
    rows = [(c, f"{c}-{i}", i, 0, f"s{i}", False, None, "vakyansh", t, p) for c, clips, _ in cases for i, (t, p) in enumerate(clips)]
    return spark.createDataFrame(rows, rc.EVIDENCE)


def existing(spark: SparkSession, cases=CASES) -> DataFrame:
    return spark.createDataFrame([(c, *e) for c, _, e in cases if e], "case_id long, hi string, en string")


#: What the names of CASES should be; that of case 4 is wrong on purpose, and case 6 has no usable clip.
TRUTH = [(1, "देहरादून"), (2, "अल्मोड़ा"), (3, "कोटद्वार"), (4, "गलत"), (6, "कुछ")]
