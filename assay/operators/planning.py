"""Planning which occurrences of names to fetch, so that few row groups are read.

Names with the fewest occurrences choose first; in each round a name takes one occurrence more, from a row group that is
read already if there is one, and on every second round (the second, the fourth ..) rather from the preferred corpus. The choice depends on all choices before it, so it is one ordered fold by its nature. What the
fold sees is cut first, by Spark and without changing the outcome: within a row group a name would only ever take its
`per_name` shortest occurrences.

Cases: durations that are null count as 0; equal occurrences are one; ties go to (corpus, path, rg, row, start); without
hits the plan is empty.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.operators import ranking

GROUP = ["corpus", "path", "rg"]
PLACE = [*GROUP, "row", "start"]


def usable(hits: DataFrame, names: DataFrame, longest: float = 16.0) -> DataFrame:
    """Hits of the asked names in sentences that are not too long."""
    return hits.where(F.coalesce("duration", F.lit(0.0)) <= longest).join(names.select("name").distinct(), "name", "left_semi")


def plan(hits: DataFrame, per_name: int = 8, max_groups: int = 700, preferred: str = "indicvoices") -> DataFrame:
    """(name, corpus, path, rg, row, start, round) of what to fetch: at most per_name of a name, from at most max_groups row groups."""
    once = hits.select("name", *PLACE, F.coalesce("duration", F.lit(0.0)).alias("duration")).distinct()
    sizes = once.groupBy("name").agg(F.count("*").alias("_n"))
    few = ranking.top_k(once, ["name", *GROUP], [F.asc("duration"), F.asc("row"), F.asc("start")], per_name)
    rows = few.join(sizes, "name")

    def fold(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["_n", "name", "duration", *PLACE], kind="stable")
        left = {name: list(t.itertuples(index=False)) for name, t in table.groupby("name", sort=False)}
        taken, groups = defaultdict(int), set()
        out = []
        for turn in range(per_name):
            for name, options in left.items():
                if taken[name] > turn or not options:
                    continue
                favour = preferred if turn % 2 else None
                at = min(range(len(options)), key=lambda i: ((options[i].corpus, options[i].path, options[i].rg) not in groups, options[i].corpus != favour, options[i].duration, i))
                x = options[at]
                group = (x.corpus, x.path, x.rg)
                if group not in groups and len(groups) >= max_groups:
                    continue
                groups.add(group)
                taken[name] += 1
                out.append((name, *(getattr(x, c) for c in PLACE), turn))
                del options[at]
        return pd.DataFrame(out, columns=["name", *PLACE, "round"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ["name", *PLACE]) + ", round int"
    return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fold, schema)
