"""Exact seeded samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean
from ..operators import sampling
from ..operators.split import temporal_split_date
from . import views
from .registry import query
from .sql import with_

RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || row_id)) AS r FROM pool)"


def labelled(spark, sf):
    return views.card(spark, sf).withColumn("y", clean.target(F.col("`Is Fraud?`")))


BALANCED = """
, pool AS (SELECT row_id, "Amount", ("Is Fraud?" IN ('Yes', '1'))::INT AS y FROM v_card),
q AS (SELECT least(sum(y), 100) AS p, sum(1 - y) AS n FROM pool), """ + RANKED + """
SELECT row_id, y{extra} FROM ranked, q WHERE r <= CASE WHEN y = 1 THEN p ELSE least(n, 1000 - p) END
"""


@query(with_("v_card", BALANCED.format(extra=', "Amount"')))
def balanced_sample(spark, sf):
    return sampling.balanced_sample(labelled(spark, sf), "y", ["row_id"], 1000, 0.1, columns=["Amount"])


@query(with_("v_card", BALANCED.format(extra="")))
def balanced_sample_ids(spark, sf):
    return sampling.balanced_sample(labelled(spark, sf).select("row_id", "y"), "y", ["row_id"], 1000, 0.1)


STRATIFIED = """
, pool AS (SELECT row_id, split, ("Is Fraud?" IN ('Yes', '1'))::INT AS y FROM {source}),
sized AS (SELECT {by} y, count(*) AS n, sum(count(*)) OVER ({part}) AS total FROM pool GROUP BY {by} y),
q AS (SELECT {by} y, n * {n} // total AS fl, n * {n} % total AS rest FROM sized),
quota AS (SELECT {by} y, fl + (row_number() OVER ({part} ORDER BY rest DESC, y) <= {n} - sum(fl) OVER ({part}))::INT AS quota FROM q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} y ORDER BY md5('42:' || row_id)) AS r FROM pool)
"""


@query(with_("v_split", STRATIFIED.format(source="v_split", by="", part="", n=300) + "SELECT row_id, y FROM ranked JOIN quota USING (y) WHERE r <= quota"))
def stratified_subsample(spark, sf):
    s, _ = temporal_split_date(labelled(spark, sf))
    return sampling.stratified_subsample(s.select("row_id", "y"), "y", 300)


@query(with_("v_split", STRATIFIED.format(source="v_split", by="split,", part="PARTITION BY split", n=150)
             + "SELECT row_id, split, y FROM ranked JOIN quota USING (split, y) WHERE r <= quota AND split IN ('val', 'test')"))
def save_eval_subsets(spark, sf):
    from ..session import materialize

    s, _ = temporal_split_date(labelled(spark, sf))
    return materialize(sampling.eval_subsets(s, "y", 150), "eval").select("row_id", "split", "y")


@query("SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || event_id)) AS r FROM events) WHERE r <= 500")
def uniform_subset(spark, sf):
    return sampling.uniform_subset(views.table(spark, sf, "events").select("event_id", "value"), 500, ["event_id"])


@query("SELECT event_id, row_number() OVER (ORDER BY md5('42:' || event_id)) - 1 AS place FROM events")
def seeded_shuffle(spark, sf):
    return sampling.seeded_shuffle(views.table(spark, sf, "events").select("event_id"), ["event_id"])
