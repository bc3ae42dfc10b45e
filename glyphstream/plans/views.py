"""Views of the given tables in the shapes that the operators take: symbol streams, landmark frames, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return events.withColumn("pos", F.row_number().over(Window.partitionBy("stream_id").orderBy("us", "event_id")))


def frames_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol stream per user: stream_id, frame_no, t_ms, symbol ('' is no reading)."""
    symbol = F.when(F.col("event_type").isin("click", "view"), "A").when(F.col("event_type").isin("purchase", "signup"), "B").otherwise("")
    return _events(spark, sf_dir).select("stream_id", F.col("pos").cast("long").alias("frame_no"), F.expr("us div 360000000").alias("t_ms"), symbol.alias("symbol"))


def log_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture log per user: stream_id, seq, label."""
    return _events(spark, sf_dir).select("stream_id", F.col("pos").cast("long").alias("seq"), F.col("event_type").alias("label"))


def tokens_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token sequence per user: stream_id, pos, label."""
    label = F.create_map(*[F.lit(x) for pair in (("click", "C"), ("view", "A"), ("purchase", "T"), ("signup", "HELLO"), ("error", "ILY")) for x in pair])[F.col("event_type")]
    return _events(spark, sf_dir).select("stream_id", F.col("pos").cast("long").alias("pos"), label.alias("label"))


def preds_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True and predicted labels: stream_id, pos, fold, true, pred."""
    tokens = tokens_ev(spark, sf_dir).withColumn("pred", F.lead("label").over(Window.partitionBy("stream_id").orderBy("pos")))
    return tokens.filter("pred is not null").select("stream_id", "pos", (F.col("stream_id") % 5).alias("fold"), F.col("label").alias("true"), "pred")


def eval_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation log: id, person, condition, expected, committed."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("c"), F.col("o_custkey") % 5).alias("person"),
        F.date_format("o_orderdate", "yyyy").alias("condition"),
        F.col("o_orderstatus").alias("expected"),
        F.regexp_replace("o_orderpriority", "[^A-Z]", "").alias("committed"),
    )


def frames_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmark frames: stream_id, person, label, frame_no, t_ms, landmarks (21 points)."""
    stream = F.concat(F.lit("p"), (F.col("vec_id") % 5).cast("string"))
    e = F.col("embedding")
    points = F.array(*[F.struct(e[2 * i].cast("double").alias("x"), e[2 * i + 1].cast("double").alias("y")) for i in range(21)])
    label = F.when(F.col("label") < 8, F.col("label").cast("string")).otherwise(F.concat(F.lit("W"), F.col("label").cast("string")))
    unknown = (stream == "p4") | ((F.col("label") == 9) & (stream != "p0"))
    return table(spark, sf_dir, "embeddings").select(stream.alias("stream_id"), F.when(unknown, "unknown").otherwise(stream).alias("person"), label.alias("label"), F.col("vec_id").alias("frame_no"), F.expr("(vec_id div 5) * 33").alias("t_ms"), points.alias("landmarks"))


#: The same views for the oracle, by name.
SQL = {
    "ev": "select user_id as stream_id, event_id, event_type, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as pos from events",
    "frames_ev": "select stream_id, pos as frame_no, us // 360000000 as t_ms, case when event_type in ('click','view') then 'A' when event_type in ('purchase','signup') then 'B' else '' end as symbol from ev",
    "log_ev": "select stream_id, pos as seq, event_type as label from ev",
    "tokens_ev": "select stream_id, pos, case event_type when 'click' then 'C' when 'view' then 'A' when 'purchase' then 'T' when 'signup' then 'HELLO' when 'error' then 'ILY' end as label from ev",
    "preds_ev": "select stream_id, pos, stream_id % 5 as fold, label as true, pred from (select *, lead(label) over (partition by stream_id order by pos) as pred from tokens_ev) where pred is not null",
    "eval_ord": "select o_orderkey as id, 'c' || (o_custkey % 5) as person, strftime(o_orderdate, '%Y') as condition, o_orderstatus as expected, regexp_replace(o_orderpriority, '[^A-Z]', '', 'g') as committed from orders",
    "frames_emb": "select 'p' || (vec_id % 5) as stream_id, case when vec_id % 5 = 4 or (label = 9 and vec_id % 5 <> 0) then 'unknown' else 'p' || (vec_id % 5) end as person, case when label < 8 then label::varchar else 'W' || label end as label, vec_id as frame_no, (vec_id // 5) * 33 as t_ms, [embedding[2*i+1]::double for i in range(21)] as xs, [embedding[2*i+2]::double for i in range(21)] as ys from embeddings",
}
_NEEDS = {"frames_ev": ["ev"], "log_ev": ["ev"], "tokens_ev": ["ev"], "preds_ev": ["ev", "tokens_ev"]}


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """SQL after the definitions of the named views."""
    if not names:
        return sql
    ordered = list(dict.fromkeys(n for name in names for n in [*_NEEDS.get(name, []), name]))
    head = ", ".join(f"{n} as ({SQL[n]})" for n in ordered)
    return f"with {'recursive ' * recursive}{head}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().lstrip('+')}"
