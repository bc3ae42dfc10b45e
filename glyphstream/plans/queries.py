"""Registered queries over the given tables, each beside the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import debounce as db
from ..operators import decision as dec
from ..operators import dispersion as disp
from ..operators import evaluate as ev
from ..operators import geometry as geo
from ..operators import hands
from ..operators import recognise as rec
from ..operators import sequence as seq
from ..operators import text as tx
from ..operators import train as tr
from . import views
from .views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Debounce thresholds that fit the units of frames_ev.
CONFIG = db.DebounceConfig(min_hold_ms=100, blank_ms=250, switch_ms=60, min_hold_frames=2, min_blank_frames=2)


def query(sql: str | None = None, *names: str, recursive: bool = False):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *names, recursive=recursive)
        return f

    return register


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


_RUNS = "+ r0 as (select *, case when symbol is not distinct from lag(symbol) over w and row_number() over w > 1 then 0 else 1 end as new from frames_ev window w as (partition by stream_id order by frame_no)), r as (select *, sum(new) over (partition by stream_id order by frame_no) as run from r0), k as (select *, row_number() over (partition by stream_id, run order by frame_no) as k from r)"
_BURSTS = "+ b0 as (select *, row_number() over w - 1 as i, case when label is not distinct from lag(label) over w then 0 else 1 end as new from log_ev window w as (partition by stream_id order by seq)), b1 as (select *, sum(new) over (partition by stream_id order by seq) as run from b0), b as (select stream_id, min(label) as label, min(i) as \"start\", max(i) + 1 as \"end\", run from b1 group by stream_id, run)"
_SESSIONS = _BURSTS + ", s as (select stream_id, run, \"start\", \"end\", label, 0 as session, [label] as seen from b where run = 1 union all select b.stream_id, b.run, b.\"start\", b.\"end\", b.label, case when list_contains(s.seen, b.label) then s.session + 1 else s.session end, case when list_contains(s.seen, b.label) then [b.label] else list_append(s.seen, b.label) end from s join b on b.stream_id = s.stream_id and b.run = s.run + 1)"


@query(_RUNS + " select stream_id, symbol, frame_no from k where k = 3 and symbol <> ''", "frames_ev")
def run_commit(spark, sf_dir):
    return seq.run_commit(views.frames_ev(spark, sf_dir))


@query(_BURSTS + ' select stream_id, label, "start", "end" from b', "log_ev")
def bursts(spark, sf_dir):
    return seq.bursts(views.log_ev(spark, sf_dir))


@query(_SESSIONS + ' select stream_id, "start", "end", label, session from s', "log_ev", recursive=True)
def sessions(spark, sf_dir):
    return seq.sessions(views.log_ev(spark, sf_dir))


@query(_SESSIONS + " select stream_id, session, label, case when length(label) > 5 then 'unknown' else 'n' || session end as person, sum(\"end\" - \"start\") as n from s group by all", "log_ev", recursive=True)
def attribute_person(spark, sf_dir):
    asked = seq.session_labels(views.log_ev(spark, sf_dir))
    names = asked.select("session").distinct().select("session", F.concat(F.lit("n"), "session").alias("person"))
    return seq.name_sessions(asked, names, n_letters=5)


@query(_SESSIONS + " select case when length(label) > 5 then 'unknown' else 'n' || session end as person, sum(\"end\" - \"start\") as n, string_agg(distinct label, ',' order by label) as labels from s group by 1", "log_ev", recursive=True)
def attribution_report(spark, sf_dir):
    return attribute_person(spark, sf_dir).groupBy("person").agg(F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"))


@query("+ k as (select *, row_number() over (partition by stream_id order by t_ms, frame_no) as k from frames_ev where symbol <> '') select stream_id, frame_no, t_ms, symbol from k where k % 2 = 0", "frames_ev")
def decimate(spark, sf_dir):
    return seq.decimate(views.frames_ev(spark, sf_dir))


@query(_RUNS + " select stream_id, frame_no, t_ms, case when symbol <> '' then symbol when k >= 5 then '' end as fed, symbol = '' and k >= 5 as clear from k", "frames_ev")
def dropout_policy(spark, sf_dir):
    return seq.dropout_policy(views.frames_ev(spark, sf_dir))


@query("+ p as (select *, lag(label) over (partition by stream_id order by pos) as p from tokens_ev) select stream_id, pos, label from p where p is null or p <> label", "tokens_ev")
def distinct_until_changed(spark, sf_dir):
    return seq.distinct_until_changed(views.tokens_ev(spark, sf_dir))


@query(_RUNS + ", c as (select stream_id, symbol, frame_no from k where k = 3 and symbol <> '') select stream_id, string_agg(symbol, '' order by frame_no) as confirmed, right(string_agg(symbol, ' ' order by frame_no), 40) as raw from c group by stream_id", "frames_ev")
def confirmed_string(spark, sf_dir):
    return seq.confirmed_string(seq.run_commit(views.frames_ev(spark, sf_dir)))


@query("+ g as (select *, t_ms - lag(t_ms) over (partition by stream_id order by t_ms, frame_no) as gap from frames_ev) select stream_id, count(*) as n, max(gap) as longest_gap, sum(gap) * 7 <= 650 * (count(*) - 1) as can_fire from g group by stream_id", "frames_ev")
def rate_floor(spark, sf_dir):
    return seq.rate_floor(views.frames_ev(spark, sf_dir))


@query("+ p as (select *, sum(case when symbol = '' then 1 else 0 end) over (partition by stream_id order by frame_no) as part from frames_ev), h as (select stream_id, frame_no, list(symbol) over (partition by stream_id, part order by frame_no rows between 5 preceding and current row) as h from p where symbol <> ''), u as (select stream_id, frame_no, unnest(h) as s, generate_subscripts(h, 1) as i from h), c as (select stream_id, frame_no, s, count(*) as n, min(i) as i from u group by all), o as (select *, row_number() over (partition by stream_id, frame_no order by n desc, i) as o from c) select stream_id, frame_no, s as smoothed, n from o where o = 1", "frames_ev")
def smoothed_symbol(spark, sf_dir):
    return seq.smoothed_symbol(views.frames_ev(spark, sf_dir))


@query(_RUNS + ", c as (select stream_id, symbol, frame_no from k where k = 3 and symbol <> ''), a as (select *, lag(symbol) over (partition by stream_id order by frame_no) as p, lag(frame_no) over (partition by stream_id order by frame_no) as since from c), bl as (select stream_id, run, min(frame_no) as lo, max(t_ms) - min(t_ms) as span from r where symbol = '' group by stream_id, run) select a.stream_id, a.frame_no, coalesce(max(span), 0) as longest_blank, coalesce(max(span), 0) >= 250 as allowed from a left join bl on a.stream_id = bl.stream_id and lo > since and lo < a.frame_no where p = a.symbol group by a.stream_id, a.frame_no", "frames_ev")
def repeat_audit(spark, sf_dir):
    frames = views.frames_ev(spark, sf_dir)
    return seq.repeat_audit(seq.run_commit(frames), frames, blank_ms=250)


@query("select m.stream_id, m.frame_no as marker, count(*) as n, string_agg(f.symbol, '' order by f.frame_no) as text from frames_ev m join frames_ev f on m.stream_id = f.stream_id and f.t_ms >= m.t_ms and f.t_ms < m.t_ms + 400 where m.frame_no % 20 = 0 group by m.stream_id, m.frame_no", "frames_ev")
def capture_windows(spark, sf_dir):
    return seq.capture_windows(views.frames_ev(spark, sf_dir), every=20, length=400)


@query("select m.stream_id, m.frame_no as marker, count(f.frame_no) as n, coalesce(string_agg(f.symbol, '' order by f.frame_no), '') as text from frames_ev m left join frames_ev f on m.stream_id = f.stream_id and f.t_ms >= m.t_ms + 150 and f.t_ms < m.t_ms + 400 where m.symbol = '' group by m.stream_id, m.frame_no", "frames_ev")
def marker_captures(spark, sf_dir):
    frames = views.frames_ev(spark, sf_dir)
    markers = frames.filter("symbol = ''").select("stream_id", F.col("frame_no").alias("marker"), (F.col("t_ms") + 150).alias("t0"))
    return seq.captures(markers, frames, length=250)


@query("select c_custkey, case when regexp_full_match(lower(trim(c_mktsegment)), '[a-z0-9_-]+') then lower(trim(c_mktsegment)) end as segment, case when regexp_full_match(lower(trim(c_name)), '[a-z0-9_-]+') then lower(trim(c_name)) end as name from customer")
def clean_keys(spark, sf_dir):
    return views.table(spark, sf_dir, "customer").select("c_custkey", seq.clean_key(F.col("c_mktsegment")).alias("segment"), seq.clean_key(F.col("c_name")).alias("name"))


_DEBOUNCE = """+ f as (select *, row_number() over (partition by stream_id order by t_ms, frame_no) as rn from frames_ev),
m as (
  select stream_id, 0::bigint as rn, null::varchar as cur, null::bigint as st, 0 as n, false as done, null::varchar as pk, null::bigint as ps, 0 as pn,
    null::bigint as rd, null::varchar as lastc, true as rel, null::varchar as committed, null::bigint as frame_no, null::bigint as t_ms
  from (select distinct stream_id from f)
  union all
  select stream_id, rn,
    case when released then null else cur2 end, st2, case when released then 0 else n2 end,
    case when released then false else done2 or fires end,
    case when released then null else pk2 end, ps2, pn2, rd2,
    case when fires and news then cur2 else lastc end,
    case when released then true when fires and news then false else rel end,
    case when fires and news then cur2 end, frame_no, t_ms
  from (
    select *, saw and not done2 and t_ms - st2 >= 100 and n2 >= 2 as fires, not (coalesce(cur2 = lastc, false) and not rel) as news,
      x = '' and cur is not null and coalesce(t_ms - rd2 >= 250, false) and pn2 >= 2 as released
    from (
      select *,
        case when x = '' then rd else t_ms end as rd2,
        case when x = '' then cur when cur is null or x = cur then x when t_ms - since >= 60 then x else cur end as cur2,
        case when x = '' or x = cur then st when cur is null then t_ms when t_ms - since >= 60 then since else st end as st2,
        case when x = '' then n when x = cur then n + 1 when cur is null then 1 when t_ms - since >= 60 then cnt else n end as n2,
        case when x = '' or x = cur then done when cur is null or t_ms - since >= 60 then false else done end as done2,
        x <> '' and (cur is null or x = cur or t_ms - since >= 60) as saw,
        case when cur is null or x = cur or (x <> '' and t_ms - since >= 60) then null else x end as pk2,
        since as ps2, cnt as pn2
      from (
        select f.stream_id, f.rn, f.frame_no, f.t_ms, f.symbol as x, m.cur, m.st, m.n, m.done, m.rd, m.lastc, m.rel,
          case when m.pk = f.symbol then m.ps else f.t_ms end as since, case when m.pk = f.symbol then m.pn + 1 else 1 end as cnt
        from m join f on f.stream_id = m.stream_id and f.rn = m.rn + 1
      )
    )
  )
),
c as (select stream_id, committed as symbol, frame_no, t_ms::double as t_ms from m where committed is not null)"""


@query(_DEBOUNCE + " select stream_id, symbol, frame_no, t_ms from c", "frames_ev", recursive=True)
def debounce(spark, sf_dir):
    return db.debounce(views.frames_ev(spark, sf_dir), CONFIG)


def _cut(every: int) -> str:
    """_DEBOUNCE over streams that every so many frames cut: each part is a stream of its own."""
    return _DEBOUNCE.replace("+ f as", f"+ parted as (select stream_id * 1000000 + count(*) filter (frame_no % {every} = 0) over (partition by stream_id order by t_ms, frame_no) as stream_id, frame_no, t_ms, symbol from frames_ev), f as").replace("from frames_ev)\n", "from frames_ev)").replace("as rn from frames_ev)", f"as rn from parted where frame_no % {every} <> 0)")


_HANDS = _DEBOUNCE.replace("+ f as", "+ parted as (select stream_id * 2 + frame_no % 2 as stream_id, frame_no, t_ms, symbol from frames_ev), f as").replace("as rn from frames_ev)", "as rn from parted)")


@query(_HANDS + " select stream_id // 2 as stream_id, stream_id % 2 as hand_id, symbol, frame_no, t_ms from c", "frames_ev", recursive=True)
def debounce_by_hand(spark, sf_dir):
    frames = views.frames_ev(spark, sf_dir).withColumn("hand_id", F.col("frame_no") % 2)
    return hands.by_hand(db.debounce, frames, CONFIG)


_FIRES = "select stream_id, 'J' as symbol, frame_no - 3 as start_frame, frame_no from frames_ev where frame_no % 25 = 0"


@query(_cut(25) + f", fires as ({_FIRES}), whole as (select stream_id // 1000000 as stream_id, symbol, frame_no from c) select stream_id, symbol, frame_no from whole where not exists (select 1 from fires where fires.stream_id = whole.stream_id and whole.frame_no between fires.start_frame and fires.frame_no) union all select stream_id, symbol, frame_no from fires", "frames_ev", recursive=True)
def commit_retraction(spark, sf_dir):
    frames = views.frames_ev(spark, sf_dir).withColumn("cut", F.col("frame_no") % 25 == 0)
    fires = frames.filter("cut").select("stream_id", F.lit("J").alias("symbol"), (F.col("frame_no") - 3).alias("start_frame"), "frame_no")
    return db.retract(db.debounce_parts(frames, CONFIG), fires)


@query(_cut(40) + ", resets as (select stream_id, count(*) filter (frame_no % 40 = 0) as part from frames_ev group by stream_id) select c.stream_id // 1000000 as stream_id, symbol, frame_no, t_ms from c join resets on c.stream_id = resets.stream_id * 1000000 + part", "frames_ev", recursive=True)
def debounce_reset(spark, sf_dir):
    return db.after_reset(views.frames_ev(spark, sf_dir).withColumn("cut", F.col("frame_no") % 40 == 0), CONFIG)


# Evaluation


@query("select label, count(*) filter (person = 'p0') as p0, count(*) filter (person = 'p1') as p1, count(*) filter (person = 'p2') as p2, count(*) filter (person = 'p3') as p3, count(*) filter (person = 'unknown') as \"unknown\" from frames_emb group by label", "frames_emb")
def label_person_pivot(spark, sf_dir):
    return ev.label_person_pivot(views.frames_emb(spark, sf_dir), ["p0", "p1", "p2", "p3", "unknown"])


@query("select label, row_number() over (order by label) - 1 as label_idx from (select distinct label from frames_emb)", "frames_emb")
def label_index(spark, sf_dir):
    return ev.label_index(views.frames_emb(spark, sf_dir))


@query("select label, count(distinct person) filter (person <> 'unknown') as n_people from frames_emb group by label having n_people < 2", "frames_emb")
def undercovered_labels(spark, sf_dir):
    return ev.undercovered_labels(views.frames_emb(spark, sf_dir))


@query("select count(*) as n, string_agg(distinct label, ',' order by label) as labels from frames_emb where person = 'unknown'", "frames_emb")
def unknown_summary(spark, sf_dir):
    return ev.unknown_summary(views.frames_emb(spark, sf_dir))


@query("select count(*) as n, count(distinct label) as n_labels, count(distinct person) as n_people from frames_emb", "frames_emb")
def dataset_summary(spark, sf_dir):
    return ev.dataset_summary(views.frames_emb(spark, sf_dir))


@query("select person as fold, (select count(*) from frames_emb) - count(*) as n_train, count(*) as n_test from frames_emb where person <> 'unknown' group by person", "frames_emb")
def logo_fold_sizes(spark, sf_dir):
    return ev.logo_folds(views.frames_emb(spark, sf_dir))


@query("select fold, round(avg((true = pred)::int), 6) as accuracy, count(*) as n from preds_ev group by fold".replace("true =", '"true" ='), "preds_ev")
def fold_accuracy(spark, sf_dir):
    return _rounded(ev.fold_accuracy(views.preds_ev(spark, sf_dir)), "accuracy")


@query('select round(sum(ok) / sum(n), 6) as pooled, round(avg(ok / n), 6) as macro from (select fold, sum(("true" = pred)::int) as ok, count(*) as n from preds_ev group by fold)', "preds_ev")
def pooled_vs_macro(spark, sf_dir):
    return _rounded(ev.pooled_vs_macro(views.preds_ev(spark, sf_dir)), "pooled", "macro")


_REPORT = '+ l as (select label, sum(tp) as tp, sum(support) as support, sum(told) as told from (select "true" as label, ("true" = pred)::int as tp, 1 as support, 0 as told from preds_ev union all select pred, 0, 0, 1 from preds_ev) group by label), rep as (select label, coalesce(tp / nullif(told, 0), 0) as precision, coalesce(tp / nullif(support, 0), 0) as recall, coalesce(2 * tp / nullif(told + support, 0), 0) as f1, support from l)'


@query(_REPORT + " select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support::bigint as support from rep", "preds_ev")
def classification_report(spark, sf_dir):
    return _rounded(ev.classification_report(views.preds_ev(spark, sf_dir)), "precision", "recall", "f1")


@query(_REPORT + " select round(avg(precision), 6) as macro_precision, round(avg(recall), 6) as macro_recall, round(avg(f1), 6) as macro_f1, round(sum(precision * support) / sum(support), 6) as weighted_precision, round(sum(recall * support) / sum(support), 6) as weighted_recall, round(sum(f1 * support) / sum(support), 6) as weighted_f1 from rep", "preds_ev")
def report_averages(spark, sf_dir):
    out = ev.report_averages(views.preds_ev(spark, sf_dir))
    return _rounded(out, *out.columns)


@query('select "true", pred, count(*) as n from preds_ev group by all', "preds_ev")
def confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(views.preds_ev(spark, sf_dir))


@query('select "true", pred, count(*) as n from preds_ev where "true" <> pred group by all order by n desc, "true" desc, pred desc limit 10', "preds_ev")
def top_confusions(spark, sf_dir):
    return ev.top_confusions(views.preds_ev(spark, sf_dir))


@query("select frame_no, label, row_number() over (partition by label order by md5('42-' || frame_no), frame_no) * 100 <= 15 * count(*) over (partition by label) as test from frames_emb", "frames_emb")
def stratified_split(spark, sf_dir):
    return ev.stratified_split(views.frames_emb(spark, sf_dir), "frame_no")


@query("select id, person, condition, contains(committed, expected) as correct from eval_ord", "eval_ord")
def eval_score(spark, sf_dir):
    return ev.eval_score(views.eval_ord(spark, sf_dir)).select("id", "person", "condition", "correct")


@query("select person, count(*) as n, sum((committed = expected)::int)::bigint as n_exact, sum(contains(committed, expected)::int)::bigint as n_correct from eval_ord group by person", "eval_ord")
def eval_rescore(spark, sf_dir):
    return ev.eval_score(views.eval_ord(spark, sf_dir)).groupBy("person").agg(F.count("*").alias("n"), F.count_if("exact").alias("n_exact"), F.count_if("correct").alias("n_correct"))


@query("select person, condition, count(*) as n, sum(contains(committed, expected)::int)::bigint as n_ok from eval_ord group by cube (person, condition)", "eval_ord")
def eval_by_condition(spark, sf_dir):
    return ev.eval_by_condition(views.eval_ord(spark, sf_dir))


@query("select person, condition, string_agg(expected || '->' || committed, ',' order by id) as misses from eval_ord where not contains(committed, expected) group by all", "eval_ord")
def eval_misses(spark, sf_dir):
    return ev.eval_misses(views.eval_ord(spark, sf_dir))


@query("+ v as (select distinct label from frames_emb union select 'W99'), p as (select distinct person from frames_emb), c as (select person, label, count(*) as c from frames_emb group by all) select p.person, v.label, coalesce(c, 0) as n, coalesce(c >= 20, false) as enough, c is null as missing from p cross join v left join c on c.person = p.person and c.label = v.label", "frames_emb")
def coverage(spark, sf_dir):
    rows = views.frames_emb(spark, sf_dir)
    asked = rows.select("label").distinct().unionByName(spark.range(1).select(F.lit("W99").alias("label")))
    return ev.coverage(rows, asked, enough=20)


@query("select case when length(\"true\") = 1 then 'letter' else 'word' end as kind, round(avg((\"true\" = pred)::int), 6) as accuracy, count(*) as n from preds_ev group by 1", "preds_ev")
def accuracy_by_label_class(spark, sf_dir):
    return _rounded(ev.accuracy_by_label_class(views.preds_ev(spark, sf_dir)), "accuracy")


@query("select label, person, 'letter of an unknown person' as reason, count(*) as n from frames_emb where person = 'unknown' and length(label) = 1 group by all", "frames_emb")
def quality_violations(spark, sf_dir):
    return ev.quality_violations(views.frames_emb(spark, sf_dir))


# Geometry. Lists are 1-based in the oracle: point i is xs[i + 1].
_SZ = "+ z as (select *, case when sqrt((xs[10]-xs[1])**2 + (ys[10]-ys[1])**2) = 0 then 1e-6 else sqrt((xs[10]-xs[1])**2 + (ys[10]-ys[1])**2) end as size from frames_emb)"
_D = lambda i: f"((xs[{i + 1}]-xs[1])*(xs[{i + 1}]-xs[1])+(ys[{i + 1}]-ys[1])*(ys[{i + 1}]-ys[1]))"
_EXT = {k: f"({_D(tip)} > {_D(pip)})" for k, (tip, pip) in geo.TIPS.items()}
_SAMPLES = _SZ + f", s as (select stream_id, frame_no, t_ms, label, {_EXT['pinky']} and not {_EXT['index']} and not {_EXT['middle']} and not {_EXT['ring']} as i_shape, {_EXT['index']} and not {_EXT['middle']} and not {_EXT['ring']} and not {_EXT['pinky']} as point_shape, xs[21]/size as pinky_x, ys[21]/size as pinky_y, xs[9]/size as index_x, ys[9]/size as index_y, list_sum(xs)/21/size as cx, list_sum(ys)/21/size as cy from z)"


@query(_SAMPLES + " select stream_id, frame_no, i_shape, point_shape from s", "frames_emb")
def handshape_flags(spark, sf_dir):
    return geo.samples(views.frames_emb(spark, sf_dir)).select("stream_id", "frame_no", "i_shape", "point_shape")


@query(_SAMPLES + " select stream_id, frame_no, round(pinky_x, 6) as pinky_x, round(pinky_y, 6) as pinky_y, round(index_x, 6) as index_x, round(index_y, 6) as index_y, round(cx, 6) as cx, round(cy, 6) as cy from s", "frames_emb")
def motion_features(spark, sf_dir):
    columns = ["pinky_x", "pinky_y", "index_x", "index_y", "cx", "cy"]
    return _rounded(geo.samples(views.frames_emb(spark, sf_dir)).select("stream_id", "frame_no", *columns), *columns)


@query(_SAMPLES + " select label, round(avg(i_shape::int), 6) as i_rate, round(avg(point_shape::int), 6) as point_rate, count(*) as n from s group by label", "frames_emb")
def gate_trip_rate(spark, sf_dir):
    rate = lambda c, name: F.avg(F.col(c).cast("double")).alias(name)
    out = geo.samples(views.frames_emb(spark, sf_dir)).withColumns({c: F.col(c).cast("int") for c in ("i_shape", "point_shape")})
    return _rounded(out.groupBy("label").agg(rate("i_shape", "i_rate"), rate("point_shape", "point_rate"), F.count("*").alias("n")), "i_rate", "point_rate")


@query("+ z as (select *, sqrt(((xs[10]-xs[1])*640)**2 + ((ys[10]-ys[1])*480)**2) as size from frames_emb), a as (select *, (xs[10]-xs[1])*640/size as ux, (ys[10]-ys[1])*480/size as uy from z), l as (select *, [((xs[i]-xs[1])*640*uy - (ys[i]-ys[1])*480*ux)/size for i in range(1, 22)] as lx, [((xs[i]-xs[1])*640*ux + (ys[i]-ys[1])*480*uy)/size for i in range(1, 22)] as ly from a) select stream_id, frame_no, i as point, round(case when lx[3] < 0 then -lx[i] else lx[i] end, 6) + 0.0 as x, round(ly[i], 6) + 0.0 as y from l, range(1, 22) t(i)", "frames_emb")
def hand_frame(spark, sf_dir):
    framed = geo.hand_frame(views.frames_emb(spark, sf_dir))
    point = framed.select("stream_id", "frame_no", "features", F.explode(F.sequence(F.lit(1), F.lit(21))).alias("point"))
    at = lambda k: (F.round(F.element_at("features", F.col("point") * 2 - k), 6) + F.lit(0.0))
    return point.select("stream_id", "frame_no", F.col("point").cast("long").alias("point"), at(1).alias("x"), at(0).alias("y"))


_WINDOW = _SAMPLES + ", w as (select *, count(*) over w as n, min(t_ms) over w as t0, count(*) filter (i_shape) over w as n_i, count(*) filter (point_shape) over w as n_point, max(cx) over w - min(cx) over w as travel, max(cy) over w - min(cy) over w as rise, pinky_y - first(pinky_y) over w as j_fall, index_y - first(index_y) over w as z_fall, first(frame_no) over w as start_frame, list(t_ms) over w as ts, list(pinky_x) over w as px, list(index_x) over w as ix, count(*) over v as m, count(*) filter (i_shape) over v as m_i, count(*) filter (point_shape) over v as m_p, sqrt((pinky_x - first(pinky_x) over v)**2 + (pinky_y - first(pinky_y) over v)**2) as pm, sqrt((index_x - first(index_x) over v)**2 + (index_y - first(index_y) over v)**2) as im from s window w as (partition by stream_id order by t_ms range between 650 preceding and current row), v as (partition by stream_id order by t_ms range between 180 preceding and current row))"
#: The tables' hands hold a shape in an eighth of a window now and then, in most of one never; an eighth is exact in binary.
EASY = geo.MotionConfig(shape_ratio=0.125)


@query(_WINDOW + " select stream_id, frame_no, n, n_i, n_point, n_i >= 0.7 * n as i_held, n_point >= 0.7 * n as point_held from w", "frames_emb")
def motion_window(spark, sf_dir):
    return geo.motion_window(views.frames_emb(spark, sf_dir)).select("stream_id", "frame_no", "n", "n_i", "n_point", "i_held", "point_held")


@query(_WINDOW + ", a as (select *, max(cy) over v - min(cy) over v as tail from w window v as (partition by stream_id order by t_ms range between 150 preceding and current row)) select stream_id, frame_no, round(travel, 6) as travel, round(rise, 6) as rise, round(tail, 6) as tail from a", "frames_emb")
def hand_travel(spark, sf_dir):
    frames = views.frames_emb(spark, sf_dir)
    across, down, tail = geo.hand_travel(frames), geo.hand_travel(frames, "y"), geo.hand_travel(frames, "y", 150)
    key = ["stream_id", "frame_no"]
    joined = across.join(down.withColumnRenamed("travel", "rise"), key).join(tail.withColumnRenamed("travel", "tail"), key)
    return _rounded(joined, "travel", "rise", "tail")


@query(_WINDOW + " select stream_id, frame_no, m >= 3 and (m_i >= m / 8 or m_p >= m / 8) and case when m_i >= m / 8 then pm else im end > 0.08 as candidate from w", "frames_emb")
def motion_candidate(spark, sf_dir):
    return geo.motion_window(views.frames_emb(spark, sf_dir), EASY).select("stream_id", "frame_no", "candidate")


@query(_WINDOW + ", h as (select *, list_filter(list_zip(ts, px), lambda q: q[1] >= t_ms - (t_ms - t0) / 3) as third from w) select stream_id, frame_no, start_frame, n >= 8 and n_i >= n / 8 and j_fall > 0.5 and len(third) >= 2 and abs(third[-1][2] - third[1][2]) > 0.25 as is_j from h", "frames_emb")
def motion_j_candidates(spark, sf_dir):
    return geo.motion_rules(views.frames_emb(spark, sf_dir), EASY).select("stream_id", "frame_no", "start_frame", "is_j")


_STROKES = _WINDOW + """, g(stream_id, frame_no, i, d, st, e, strokes) as (
  select stream_id, frame_no, 1::bigint, 0, ix[1], ix[1], []::int[] from w where n >= 8
  union all
  select stream_id, frame_no, i + 1,
    case when d = 0 and abs(x - st) > 0.08 then case when x > st then 1 else -1 end when d <> 0 and (x - e) * d <= 0 and abs(x - e) > 0.08 then -d else d end,
    case when d <> 0 and (x - e) * d <= 0 and abs(x - e) > 0.08 then e else st end,
    case when (d = 0 and abs(x - st) > 0.08) or (d <> 0 and ((x - e) * d > 0 or abs(x - e) > 0.08)) then x else e end,
    case when d <> 0 and (x - e) * d <= 0 and abs(x - e) > 0.08 and abs(e - st) >= 0.25 then list_append(strokes, d) else strokes end
  from (select g.*, w.ix[(i + 1)::int] as x from g join w using (stream_id, frame_no) where i < w.n)
), k as (select g.stream_id, g.frame_no, start_frame, case when d <> 0 and abs(e - st) >= 0.25 then list_append(strokes, d) else strokes end as q, travel, z_fall, n_point, w.n from g join w on g.stream_id = w.stream_id and g.frame_no = w.frame_no and g.i = w.n)"""


@query(_STROKES + " select stream_id, frame_no, len(q) as n_strokes from k", "frames_emb", recursive=True)
def strokes(spark, sf_dir):
    frames = views.frames_emb(spark, sf_dir)
    full = geo.motion_window(frames, EASY).filter("n >= 8").select("stream_id", "frame_no")
    return geo.motion_rules(frames, EASY).join(full, ["stream_id", "frame_no"], "left_semi").select("stream_id", "frame_no", "n_strokes")


@query(_STROKES + ", h as (select *, list_filter(list_zip(ts, px), lambda q: q[1] >= t_ms - (t_ms - t0) / 3) as third from w) select h.stream_id, h.frame_no, case when n < 8 then n || '/8 samples' end as status, case when n >= 8 then t_ms - t0 end as span_ms, case when n >= 8 then n_i end as n_i, case when n >= 8 then h.n_point end as n_point, len(q) as n_strokes, case when n >= 8 then round(j_fall, 3) + 0.0 end as j_drop, case when n >= 8 then round(abs(third[-1][2] - third[1][2]), 3) end as j_hook, case when n >= 8 then round(h.z_fall, 3) + 0.0 end as z_drift, case when n >= 8 then round(h.travel, 3) end as hand_travel from h left join (select stream_id, frame_no, q from k) k on k.stream_id = h.stream_id and k.frame_no = h.frame_no", "frames_emb", recursive=True)
def motion_diagnostics(spark, sf_dir):
    return geo.motion_diagnostics(views.frames_emb(spark, sf_dir))


@query(_STROKES + " select stream_id, frame_no, start_frame, n_point >= n / 8 and travel >= 0.3 and len(q) >= 3 and q[-3] = q[-1] and q[-2] <> q[-1] and z_fall > 0.3 as is_z from k", "frames_emb", recursive=True)
def motion_z_candidates(spark, sf_dir):
    frames = views.frames_emb(spark, sf_dir)
    full = geo.motion_window(frames, EASY).filter("n >= 8").select("stream_id", "frame_no")
    return geo.motion_rules(frames, EASY).join(full, ["stream_id", "frame_no"], "left_semi").select("stream_id", "frame_no", "start_frame", "is_z")


@query("select stream_id, frame_no, trunc(list_min(xs) * 640)::int - 20 as x0, trunc(list_min(ys) * 480)::int - 20 as y0, trunc(list_max(xs) * 640)::int + 20 as x1, trunc(list_max(ys) * 480)::int + 20 as y1 from frames_emb", "frames_emb")
def bounding_box(spark, sf_dir):
    return geo.bounding_box(views.frames_emb(spark, sf_dir))


# Text

_PHRASES = " union all ".join(f"select '{k}' as label, '{v}' as phrase" for k, v in tx.PHRASES.items())


@query(f"+ ph as ({_PHRASES}), t0 as (select *, case when length(label) > 1 or coalesce(length(lag(label) over w) > 1, true) then 1 else 0 end as new from tokens_ev window w as (partition by stream_id order by pos)), t1 as (select *, sum(new) over (partition by stream_id order by pos) as piece from t0), t2 as (select stream_id, piece, string_agg(coalesce(phrase, label), '' order by pos) as s from t1 left join ph using (label) group by all) select stream_id, string_agg(s, ' ' order by piece) as text from t2 group by stream_id", "tokens_ev")
def token_pieces(spark, sf_dir):
    phrases = spark.createDataFrame(list(tx.PHRASES.items()), "label string, phrase string")
    return tx.token_pieces(views.tokens_ev(spark, sf_dir), phrases)


def _boosts(spark):
    return spark.range(1).select(F.explode(F.array(F.lit("the"), F.lit("agenda"))).alias("term"), F.lit(10**9).cast("long").alias("cnt"))


@query("select term, sum(cnt)::bigint as cnt from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as term, 1 as cnt from documents where lang = 'en' union all select unnest(['the', 'agenda']), 1000000000) group by term")
def vocabulary(spark, sf_dir):
    return tx.vocabulary(views.table(spark, sf_dir, "documents").filter("lang = 'en'"), _boosts(spark))


_ACADEMIC = ", ".join(f"'{w}'" for w in tx.DOMAIN_WORDS["academic"])


@query(f"select term, sum(cnt)::bigint as cnt from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as term, 1 as cnt from documents union all select unnest(['the', 'agenda', {_ACADEMIC}]), 1000000000) group by term")
def vocabulary_of_mode(spark, sf_dir):
    words = spark.createDataFrame([(w, 10**9, mode) for mode, own in [*tx.DOMAIN_WORDS.items(), ("another", ["absent"])] for w in own], "term string, cnt long, mode string")
    boosts = _boosts(spark).withColumn("mode", F.lit(None).cast("string")).unionByName(words)
    return tx.vocabulary(views.table(spark, sf_dir, "documents"), boosts, mode="academic")


@query("""with v as (select term, sum(cnt) as cnt from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as term, 1 as cnt from documents where lang = 'en' union all select unnest(['the', 'agenda']), 1000000000) group by term),
a as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as term from benchmark),
p as (select a.term, v.term as suggestion, levenshtein(a.term, v.term) as distance, cnt from a join v on length(v.term) between length(a.term) - 2 and length(a.term) + 2 where levenshtein(a.term, v.term) <= 2)
select term, suggestion, distance from (select *, row_number() over (partition by term order by distance, cnt desc, suggestion) as o from p) where o = 1""")
def spell_candidates(spark, sf_dir):
    vocab = tx.vocabulary(views.table(spark, sf_dir, "documents").filter("lang = 'en'"), _boosts(spark))
    asked = views.table(spark, sf_dir, "benchmark").select(F.explode(F.expr("regexp_extract_all(lower(text), '[a-z]+', 0)")).alias("term"))
    return tx.spell_candidates(asked, vocab)


_WORDS = "v as (select term, count(*) as cnt from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as term from documents) group by term), total as (select sum(cnt) as total from v)"


_SPLIT = (
    "+ t0 as (select stream_id, pos, label, case when length(label) > 1 then 1 else 0 end as word from tokens_ev), t1 as (select *, sum(word) over (partition by stream_id order by pos) as piece from t0), letters as (select distinct string_agg(lower(label), '' order by pos) as run from t1 where word = 0 group by stream_id, piece), " + _WORDS + """,
known as (select run, map(list(start * 21 + size), list(round((log10(total) - log10(cnt)) * 1000)::bigint)) as known from (select run, start, size, substr(run, (start + 1)::int, size::int) as term from (select run, start, unnest(range(1, least(20, length(run) - start) + 1)) as size from (select run, unnest(range(length(run))) as start from letters))) join v using (term), total group by run),
b(run, e, a) as (
  select run, 0::bigint, [{'c': 0::bigint, 'k': 0::bigint, 't': ''}] from letters
  union all
  select run, e + 1, list_append(a, list_sort(list_transform(range(1, least(e + 1, 20) + 1), lambda n: {
    'c': a[e + 2 - n].c + coalesce(known[(e + 1 - n) * 21 + n], (round(log10(total) * 1000))::bigint + 1000 * (n - 1)),
    'k': a[e + 2 - n].k + 1, 't': a[e + 2 - n].t || case when e + 1 = n then '' else ' ' end || substr(run, (e + 2 - n)::int, n::int)}))[1])
  from b left join known using (run), total where e < length(run))"""
)


@query(_SPLIT + " select run, a[-1].t as text from b where e = length(run)", "tokens_ev", recursive=True)
def segment_runs(spark, sf_dir):
    tokens = views.tokens_ev(spark, sf_dir)
    w = Window.partitionBy("stream_id").orderBy("pos")
    piece = F.sum((F.length("label") > 1).cast("int")).over(w)
    spelt = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.lower("label").alias("s")))), lambda x: x["s"]), "")
    letters = tokens.withColumn("piece", piece).filter("length(label) = 1").groupBy("stream_id", "piece").agg(spelt.alias("run"))
    vocab = tx.vocabulary(views.table(spark, sf_dir, "documents"), _boosts(spark).filter("false"))
    return tx.segment_runs(letters, vocab)


_PHRASED = "case label " + " ".join(f"when '{k}' then '{v}'" for k, v in tx.PHRASES.items()) + " else label end"


@query(_SPLIT + f", p as (select stream_id, min(pos) as place, string_agg(lower(label), '' order by pos) as run from t1 where word = 0 group by stream_id, piece), s as (select stream_id, place, a[-1].t as s from p join b on b.run = p.run and e = length(p.run) union all select stream_id, pos, {_PHRASED} from t1 where word = 1) select stream_id, string_agg(s, ' ' order by place) as text from s group by stream_id", "tokens_ev", recursive=True)
def correct_sequence(spark, sf_dir):
    phrases = spark.createDataFrame(list(tx.PHRASES.items()), "label string, phrase string")
    vocab = tx.vocabulary(views.table(spark, sf_dir, "documents"), _boosts(spark).filter("false"))
    return tx.correct_sequence(views.tokens_ev(spark, sf_dir), phrases, vocab)


# --- spread, gates, decisions, training ---


def _features(spark, sf_dir):
    points = [F.transform("landmarks", lambda p: p["x"]), F.transform("landmarks", lambda p: p["y"])]
    return views.frames_emb(spark, sf_dir).withColumn("features", F.concat(*points))


_LONG = "+ x as (select stream_id, label, person, frame_no, unnest(range(42)) as k, unnest(list_concat(xs, ys)) as v from frames_emb)"


@query(_LONG + ", m as (select label, person, k, avg(v) as a, sum(v) as s, count(*) as n from x group by all), t as (select *, (sum(s) over (partition by label, k) - s) / nullif(sum(n) over (partition by label, k) - n, 0) as o from m), c as (select label, person, any_value(n) as n, sqrt(sum((a - o) ** 2)) as d from t group by all), r as (select x.label, x.person, frame_no, sqrt(sum((v - a) ** 2)) as l from x join m using (label, person, k) group by all), q as (select label, person, avg(l) as spread from r group by all) select label, person, n, round(d, 6) as centroid_distance, round(spread, 6) as spread from c join q using (label, person)", "frames_emb")
def dispersion(spark, sf_dir):
    return _rounded(disp.dispersion(_features(spark, sf_dir), 42), "centroid_distance", "spread")


@query(_LONG + ", l as (select *, lag(v) over w as pv, lag(label) over w as pl from x window w as (partition by stream_id, k order by frame_no)), d as (select label, frame_no, sum((v - pv) ** 2) as d from l where pl = label group by all), n as (select label, count(*) as n_near, avg(d) as near from d group by label), f as (select label, sum(vs) as far from (select label, k, 2 * var_samp(v) as vs from x group by all) group by label) select f.label, coalesce(n_near, 0) as n_near, round(near, 6) as near, round(far, 6) as far from f left join n on f.label = n.label", "frames_emb")
def leakage_ratio(spark, sf_dir):
    return _rounded(disp.leakage_ratio(_features(spark, sf_dir), 42), "near", "far")


# Points in the hand's own frame; the distance of points 1 and 10 is its unit.
_OWN = lambda a, b: f"[{{'x': (({a}[i] - {a}[1]) * ({b}[10] - {b}[1]) - ({b}[i] - {b}[1]) * ({a}[10] - {a}[1])) / greatest(1e-12, ({a}[10] - {a}[1])**2 + ({b}[10] - {b}[1])**2), 'y': (({a}[i] - {a}[1]) * ({a}[10] - {a}[1]) + ({b}[i] - {b}[1]) * ({b}[10] - {b}[1])) / greatest(1e-12, ({a}[10] - {a}[1])**2 + ({b}[10] - {b}[1])**2)}} for i in range(1, 22)]"
_INVARIANCE = f"""+ m as (
  select 'shift' as transform, xs, ys, [x + 0.37 for x in xs] as mx, [y - 0.21 for y in ys] as my from frames_emb
  union all select 'scale', xs, ys, [x * 1.7 for x in xs], [y * 1.7 for y in ys] from frames_emb
  union all select 'rotation', xs, ys, [xs[i] * 0.8 - ys[i] * 0.6 for i in range(1, 22)], [xs[i] * 0.6 + ys[i] * 0.8 for i in range(1, 22)] from frames_emb),
own as (select transform, {_OWN("xs", "ys")} as p, {_OWN("mx", "my")} as q from m),
moved as (select transform, list_max([greatest(abs(p[i].x * (case when p[3].x < 0 then -1 else 1 end) - q[i].x * (case when q[3].x < 0 then -1 else 1 end)), abs(p[i].y - q[i].y)) for i in range(1, 22)]) as change from own)
select transform, count(*) as n, max(change) < 1e-6 as invariant from moved group by transform"""


@query(_INVARIANCE, "frames_emb")
def invariance_audit(spark, sf_dir):
    return disp.invariance_audit(views.frames_emb(spark, sf_dir))


_CANDIDATE = "m >= 3 and (m_i >= m / 8 or m_p >= m / 8) and case when m_i >= m / 8 then pm else im end > 0.08 as candidate"
_PROBS = "+ p as (select vec_id as frame_no, [abs(e::double) for e in embedding[1:10]] as p from embeddings), q as (select frame_no, list_max(p) as best, list_position(p, list_max(p)) - 1 as i from p), g as (select frame_no, case when best > 0.25 then i::varchar else '' end as gated from q)"


def _gated(spark, sf_dir):
    p = F.transform(F.slice("embedding", 1, 10), lambda x: F.abs(x.cast("double")))
    labels = F.array(*[F.lit(str(i)) for i in range(10)])
    return views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_no"), dec.confidence_gate(p, labels, 0.25).alias("gated"))


@query(_PROBS + " select frame_no, gated from g", "frames_emb")
def confidence_gate(spark, sf_dir):
    return _gated(spark, sf_dir)


_FIRE = """, f0 as (select stream_id, frame_no, t_ms, i_shape, point_shape, pinky_x, pinky_y, index_x, index_y, cx, row_number() over (partition by stream_id order by t_ms, frame_no) as rn from s where {which}),
f as (select *, list({'rn': rn, 't': t_ms, 'f': frame_no, 'i': i_shape, 'p': point_shape, 'px': pinky_x, 'py': pinky_y, 'x': index_x, 'y': index_y, 'c': cx}) over (partition by stream_id order by t_ms range between 650 preceding and current row) as buf from f0),
fire(stream_id, rn, cleared, symbol, start_frame, frame_no) as (
  select distinct stream_id, 0::bigint, 0::bigint, null::varchar, null::bigint, null::bigint from f
  union all
  select stream_id, rn, case when symbol is not null then rn else cleared end, symbol, b[1].f, frame_no from (
    select *, case when len(b) < 8 then null
      when 8 * len(list_filter(b, lambda q: q.i)) >= len(b) and b[-1].py - b[1].py > 0.5 and len(third) >= 2 and abs(third[-1].px - third[1].px) > 0.25 then 'J'
      when 8 * len(list_filter(b, lambda q: q.p)) >= len(b) and list_max(list_transform(b, lambda q: q.c)) - list_min(list_transform(b, lambda q: q.c)) >= 0.3
        and b[-1].y - b[1].y > 0.3 and len(ways) >= 3 and sign(ways[-1]) = sign(ways[-3]) and sign(ways[-1]) <> sign(ways[-2]) then 'Z' end as symbol
    from (select *, list_filter(list_transform(range(1, len(turns)), lambda i: turns[i + 1] - turns[i]), lambda d: abs(d) >= 0.25) as ways from (
      select *, list_filter(b, lambda q: q.t >= b[-1].t - (b[-1].t - b[1].t) / 3) as third,
        list_reduce(list_concat([[b[1].x, b[1].x]], list_transform(b, lambda q: [q.x])), lambda a, x:
          case when (x[1] - a[-1]) * (a[-1] - a[-2]) > 0 or (a[-1] = a[-2] and abs(x[1] - a[-1]) > 0.08) then list_append(a[:-2], x[1])
            when a[-1] <> a[-2] and abs(x[1] - a[-1]) > 0.08 then list_append(a, x[1]) else a end) as turns
      from (select f.*, fire.cleared, list_filter(f.buf, lambda q: q.rn > fire.cleared) as b from fire join f on f.stream_id = fire.stream_id and f.rn = fire.rn + 1)))))"""


@query(_SAMPLES + _FIRE.replace("{which}", "true") + " select stream_id, symbol, start_frame, frame_no from fire where symbol is not null", "frames_emb", recursive=True)
def motion_fires(spark, sf_dir):
    return dec.motion_fires(views.frames_emb(spark, sf_dir), EASY)


_NO_HAND = ("2", "3", "5", "7")


def _handed(spark, sf_dir):
    """Frames with hand and gated."""
    return views.frames_emb(spark, sf_dir).withColumn("hand", ~F.col("label").isin(*_NO_HAND)).join(_gated(spark, sf_dir), "frame_no")


@query(_WINDOW + _FIRE.replace("{which}", f"label not in {_NO_HAND}") + _PROBS.replace("+ p as", ", p as") + f", d as (select w.stream_id, w.frame_no, w.label not in {_NO_HAND} as hand, fire.symbol as motion, CANDIDATE, gated from w join g using (frame_no) left join fire on fire.frame_no = w.frame_no and fire.symbol is not null), e as (select *, sum(hand::int) over (partition by stream_id order by frame_no) as part from d), h as (select *, count(*) filter (not hand) over (partition by stream_id, part order by frame_no) as missed from e) select stream_id, frame_no, case when not hand and missed >= 5 then '' when not hand or motion is not null then null when candidate then '' else gated end as fed, not hand and missed >= 5 as clear from h".replace("CANDIDATE", _CANDIDATE), "frames_emb", recursive=True)
def frame_decision(spark, sf_dir):
    frames = _handed(spark, sf_dir)
    fires = dec.motion_fires(frames.filter("hand"), EASY).select("frame_no", F.col("symbol").alias("motion"))
    marks = geo.motion_window(views.frames_emb(spark, sf_dir), EASY).select("frame_no", "candidate")
    return dec.frame_decision(frames.join(marks, "frame_no").join(fires, "frame_no", "left")).select("stream_id", "frame_no", "fed", "clear")


@query()
def recognise(spark, sf_dir):
    return rec.standing(rec.recognise(_handed(spark, sf_dir), CONFIG, EASY))


@query('select pos // 20 as take, round(avg(("true" = pred)::int), 6) as accuracy, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from preds_ev group by 1', "preds_ev")
def accuracy_by_take(spark, sf_dir):
    takes = views.preds_ev(spark, sf_dir).withColumn("take", F.expr("pos div 20"))
    return _rounded(ev.accuracy_by_take(takes), "accuracy", "share")


@query()
def train_and_score(spark, sf_dir):
    return tr.leave_one_out(_features(spark, sf_dir).select("person", "label", "features"), 42)


@query()
def seed_sweep(spark, sf_dir):
    return tr.seed_sweep(_features(spark, sf_dir).select("person", "label", "features"), 42, (42, 43))


@query()
def learning_curve(spark, sf_dir):
    return tr.learning_curve(_features(spark, sf_dir).select("person", "label", "features"), 42)


@query()
def ablation(spark, sf_dir):
    return tr.ablation(_features(spark, sf_dir).select("person", "label", "features"), 42)
