"""Taking in recordings that were uploaded for a name: a new case with its clips, transcripts and record.

The store's tables are those of `sources.tables.SCHEMAS`. A case is named by its normal spelling, so one that is uploaded
again keeps its number, its decisions and its log; its clips, transcripts and record are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import devanagari as dv
from assay.operators import reconcile as rc
from assay.sources import tables
from assay.sources.shared import cut

KIND, SOURCE = "field recording", "officer upload"


def case_number(name: str) -> Column:
    """A number of a case's own, from its spelling: 52 bits, so that it is exact as a double too."""
    return F.shiftrightunsigned(F.xxhash64(name), 12)


def take_in(store: dict[str, DataFrame], uploads: DataFrame, gazetteer: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the tables cases, clips and witness with the uploads in them, the records of the cases that were uploaded).

    uploads: upload, name_hi, existing_en, clip_id, file, seq, wseq, witness, text, conf, snr_db, dur_s, created. An upload
    without a name is called by its first clip's surest text. Uploads without any usable text make no case.
    """
    weighted = uploads.where(F.col("witness").isin(*rc.WITNESS_WEIGHTS))
    first = weighted.groupBy("upload").agg(F.max_by(dv.normalise(F.col("text")), F.struct(-F.col("seq"), "conf", -F.col("wseq"))).alias("_heard"))
    told = uploads.groupBy("upload").agg(F.first("name_hi", True).alias("_given"), F.first("existing_en", True).alias("existing_en"), F.max("created").alias("created"))
    label = F.coalesce(F.nullif(dv.normalise(F.col("_given")), F.lit("")), F.nullif(F.col("_heard"), F.lit("")))
    named = told.join(first, "upload", "left").withColumn("name", label).where("name IS NOT NULL")
    named = cut(named.withColumn("case_id", case_number("name")).select("upload", "case_id", "name", "existing_en", "created", (F.trim(F.coalesce("_given", F.lit(""))) != "").alias("_by_hand")))
    heard = cut(uploads.drop("name_hi", "existing_en", "created").join(named.select("upload", "case_id"), "upload"))
    evidence = heard.select("case_id", "clip_id", "seq", "wseq", F.concat(F.lit("upload-"), "clip_id").alias("speaker"), F.lit(False).alias("synthetic"), "snr_db", "witness", "text", "conf")
    given = named.where("_by_hand").groupBy("case_id").agg(F.first("name").alias("hi"), F.first("existing_en").alias("en"))
    records = rc.reconcile(evidence, given, gazetteer)
    cases = named.groupBy(F.col("case_id").alias("id")).agg(F.first("name").alias("name_hi"), F.lit(KIND).alias("kind"), F.first("existing_en", True).alias("existing_en"), F.lit(SOURCE).alias("existing_src"), F.lit("").alias("item"), F.lit("pending").alias("status"), F.max("created").alias("created"))
    clips = heard.groupBy(F.col("clip_id").alias("id")).agg(F.first("case_id").alias("case_id"), F.first("file").alias("file"), F.first("snr_db").alias("snr_db"), F.first("dur_s").alias("dur_s"))
    clips = clips.select("id", "case_id", "file", F.lit("upload").alias("corpus"), F.lit("officer recording").alias("licence"), F.concat(F.lit("upload-"), "id").alias("speaker"), F.lit(0.0).alias("start_s"), F.col("dur_s").alias("end_s"), "dur_s", "snr_db", F.lit(False).alias("synthetic"), F.lit(0.0).alias("cut_cer"))
    clips = store["clips"].limit(0).unionByName(clips, allowMissingColumns=True)
    witness = heard.select("clip_id", "witness", "text", "conf")
    gone = store["clips"].join(named.select("case_id").distinct(), "case_id", "left_semi").select(F.col("id").alias("clip_id"))
    out = {
        "cases": tables.upsert(store["cases"], cases.select(*store["cases"].columns), ["id"]),
        "clips": tables.replace_by_key(store["clips"], clips, "case_id", named),
        "witness": tables.upsert(tables.replace_by_key(store["witness"], witness.limit(0), "clip_id", gone), witness, ["clip_id", "witness"]),
    }
    return out, records
