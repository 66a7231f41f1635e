"""What reviewers ask of the store: totals, the queue, one case, decisions, the log, the approved export and a preview.

Every function is a plan over the tables of `sources.tables.SCHEMAS`; records are the rows of the reconciliation. Writing is
the caller's: `decide` returns the rows to append and the new status, so that one writer keeps the log in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assay.functions import devanagari as dv
from assay.functions import phonology, text
from assay.operators import audit

STATUS = {"approve": "approved", "reject": "rejected", "hold": "on hold"}
EXPORT = ["name_hi", "devanagari", "roman", "ipa", "kind", "existing_en", "officer", "approved_at", "audit_hash"]


def totals(cases: DataFrame, clips: DataFrame) -> DataFrame:
    """(what, n): cases by status, all cases, clips and speakers."""
    by = cases.groupBy(F.col("status").alias("what")).agg(F.count("*").alias("n"))
    every = cases.agg(F.count("*").alias("n")).select(F.lit("cases").alias("what"), "n")
    heard = clips.agg(F.count("*").alias("clips"), F.countDistinct("speaker").alias("speakers"))
    return by.unionByName(every).unionByName(heard.select(F.inline(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in ("clips", "speakers")]))))


def queue(cases: DataFrame, records: DataFrame, status: str = "", needle: str = "", band: str = "") -> DataFrame:
    """Cases with the heads of their records, by name; empty arguments don't filter. Cases without a record stay."""
    head = records.select(
        F.col("case_id").alias("id"), "devanagari", F.col("roman.recommended").alias("roman"), "ipa", F.col("confidence.score").alias("confidence"), F.col("confidence.band").alias("band"),
        F.col("confidence.clips").alias("clips"), F.col("confidence.speakers").alias("speakers"), F.col("flags"), F.size("variants").alias("variants"),
    )
    picked = cases.where(F.col("status") == status) if status else cases
    out = picked.select("id", "name_hi", "kind", "existing_en", "status").join(head, "id", "left")
    out = out.withColumn("flags", F.coalesce("flags", F.array().cast("array<string>"))).withColumn("variants", F.coalesce("variants", F.lit(0)))
    if band:
        out = out.where(F.col("band") == band)
    return out.where(text.matches_any(needle, ["name_hi"], ["existing_en", "roman"])).orderBy("name_hi", "id")


def by_confidence(queued: DataFrame, direction: str = "desc", most: int = 500) -> DataFrame:
    """(id, confidence, place) of a queue by confidence, missing ones as 0; equal ones by name."""
    value = F.coalesce("confidence", F.lit(0.0))
    ordered = queued.select("id", "name_hi", value.alias("confidence")).orderBy(F.desc("confidence") if direction == "desc" else F.asc("confidence"), "name_hi", "id").limit(most)
    order = W.orderBy(F.desc("confidence") if direction == "desc" else F.asc("confidence"), "name_hi", "id")  # over `most` rows
    return ordered.withColumn("place", F.row_number().over(order).cast("long")).select("id", "confidence", "place")


def files_of(asked: DataFrame, clips: DataFrame) -> DataFrame:
    """(id, file) of the clips that are asked for; those that are not known are left out."""
    return asked.select("id").distinct().join(clips.select("id", "file"), "id")


def case(case_id: int, clips: DataFrame, witness: DataFrame) -> DataFrame:
    """The clips of a case by how well they were cut, each with its transcripts by witness; vectors are left out."""
    mine = clips.where(F.col("case_id") == case_id).drop("xvec")
    heard = witness.join(mine.select(F.col("id").alias("clip_id")), "clip_id", "left_semi")
    heard = heard.groupBy("clip_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("witness", F.struct("text", "conf"))))).alias("witnesses"))
    return mine.join(heard.withColumnRenamed("clip_id", "id"), "id", "left").orderBy(F.asc_nulls_first("cut_cer"), "id")


def refusals(decisions: DataFrame) -> DataFrame:
    """Decisions (officer, action, reason) with why they are refused; null if they are not."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    why = F.when(~F.coalesce(F.col("action").isin(*STATUS), F.lit(False)), "unknown action").when(blank("officer"), "an officer is required").when((F.col("action") != "approve") & blank("reason"), "a reason is required")
    return decisions.withColumn("refused", why)


def decide(decisions: DataFrame, records: DataFrame) -> DataFrame:
    """Accepted decisions (case_id, officer, action, reason, devanagari, roman, ipa, notes) with final values, edited_fields and status.

    Empty fields take the record's value. A case without a record keeps what the officer wrote.
    """
    ours = records.select("case_id", F.col("devanagari").alias("_d"), F.col("roman.recommended").alias("_r"), F.col("ipa").alias("_i"))
    out = refusals(decisions).where("refused IS NULL").drop("refused").join(ours, "case_id", "left")
    given = lambda c, own: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(own), F.lit(""))
    final = {"devanagari": dv.normalise(given("devanagari", "_d")), "roman": F.trim(given("roman", "_r")), "ipa": given("ipa", "_i"), "notes": F.coalesce("notes", F.lit(""))}
    out = out.withColumns(final)
    edited = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(own)), c) for c, own in (("devanagari", "_d"), ("roman", "_r"), ("ipa", "_i"))]))
    status = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.col("action"))
    return out.withColumn("edited_fields", edited).withColumn("status", status).drop("_d", "_r", "_i")


def with_status(cases: DataFrame, decided: DataFrame, order: str = "id") -> DataFrame:
    """Cases under the status of their last decision, by `order`."""
    last = decided.groupBy(F.col("case_id").alias("id")).agg(F.max_by("status", order).alias("_status"))
    return cases.join(last, "id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status").select(*cases.columns)


def log(entries: DataFrame, case_id: int = 0, newest: int = 500) -> DataFrame:
    """The newest entries of the log, of one case or (0) of all."""
    return (entries.where(F.col("case_id") == case_id) if case_id else entries).orderBy(F.desc("id")).limit(newest)


def checked_log(entries: DataFrame) -> DataFrame:
    return audit.verify(entries)


def approved(cases: DataFrame, decisions: DataFrame, entries: DataFrame) -> DataFrame:
    """The export: approved cases under their last decision, with the hash of their last approval."""
    last = decisions.groupBy("case_id").agg(F.max_by(F.struct("record", "officer", "ts"), "id").alias("d"))
    hashes = entries.where("action = 'approve'").groupBy("case_id").agg(F.max_by("hash", "id").alias("audit_hash"))
    out = cases.where("status = 'approved'").join(last, F.col("id") == F.col("case_id")).drop("case_id").join(hashes, F.col("id") == F.col("case_id"), "left")
    at = F.date_format(F.timestamp_seconds("d.ts"), "yyyy-MM-dd HH:mm")
    return out.select("name_hi", "d.record.devanagari", "d.record.roman", "d.record.ipa", "kind", "existing_en", "d.officer", at.alias("approved_at"), F.coalesce("audit_hash", F.lit("")).alias("audit_hash"))


def preview(names: DataFrame, name: str = "name") -> DataFrame:
    """names with the normal form, IPA and Roman letters of edited spellings."""
    return names.withColumn("devanagari", dv.normalise(F.col(name))).withColumn("_s", phonology.sound("devanagari")).select(*names.columns, "devanagari", F.col("_s.ipa").alias("ipa"), F.col("_s.scheme").alias("roman"))
