"""Queries for utility metrics and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracekit.operators import utility as U
from tracekit.operators.sampling import three_way_split
from tracekit.plans.registry import query, table
from tracekit.session import fraction, scratch_path, tidy
from tracekit.sources import results

NUM = ["size", "price", "stock"]


def _parts(spark, sf):
    """Parts with a target that depends on the columns: real rows are odd, synthetic rows even."""
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("key"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"),
        (F.col("p_partkey") * 37 % 101).cast("double").alias("stock"), F.col("p_type").alias("kind"))
    p = p.withColumn("cls", (F.col("size") + F.col("stock") / 4 > 38).cast("int"))
    return p.withColumn("grade", F.least(F.floor(F.col("size") / 17), F.lit(2)).cast("int"))


def _prepared(spark, sf, target="cls", positive=None):
    p = three_way_split(_parts(spark, sf), (0.6, 0.2, 0.2), "u", "key")
    real, syn = p.where("key % 2 = 1"), p.where("key % 2 = 0")
    train, val, test = (real.where(F.col("split") == s) for s in ("train", "val", "test"))
    return U.prepare(train, [syn, val, test], NUM, ["kind"], target, positive)


def _width(df):
    return df.select(F.size("features")).first()[0]


@query("u1_train_on_both")
def u1(spark, sf):
    train, syn, _, test = _prepared(spark, sf, "grade", positive=1)
    model = U.learners(_width(train), 2)["logistic"]
    return U.train_on_both(model, train, syn, test, "key")


@query("u2_utility_difference")
def u2(spark, sf):
    train, syn, _, test = _prepared(spark, sf)
    halves = [syn.where("key % 4 = 0"), syn.where("key % 4 = 2")]
    return U.utility_difference(U.learners(_width(train), 2), train, halves, test, 2)


@query("u3_simple_learners")
def u3(spark, sf):
    train, syn, val, test = _prepared(spark, sf)
    sources = {k: U.training_source(train, syn, k) for k in ("real", "synthetic", "merged")}
    return U.score_learners(U.learners(_width(train), 2), sources, {"val": val, "test": test}, lambda p: U.evaluate(p, 2))


@query("u3_simple_regressors")
def u3_regression(spark, sf):
    train, syn, val, test = _prepared(spark, sf, "price")
    return U.score_learners(U.regressors(), {"real": train, "synthetic": syn}, {"test": test}, U.regression_scores)


@query("u4_boosted_trees")
def u4(spark, sf):
    train, syn, val, test = _prepared(spark, sf)
    model = U.boosted("binclass", validation="is_val")
    sources = {"real": U.early_stopping_rows(train, val), "synthetic": U.early_stopping_rows(syn, val)}
    return U.score_learners({"boosted": model}, sources, {"test": test}, lambda p: U.evaluate(p, 2))


@query("u4_boosted_multiclass")
def u4_multi(spark, sf):
    train, syn, val, test = _prepared(spark, sf, "grade")
    sources = {"real": U.early_stopping_rows(train, val), "synthetic": U.early_stopping_rows(syn, val)}
    return U.score_learners({"boosted": U.boosted("multiclass", 3, validation="is_val")}, sources, {"test": test}, lambda p: U.evaluate(p, 3))


@query("u5_repeated_seeds", """select source, 'test' as split, metric, 4 as count, true as within from (select unnest(['real', 'synthetic']) as source),
(select unnest(['acc', 'f1', 'roc_auc']) as metric)""")
def u5_seeds(spark, sf):
    """Two dataset seeds and two model seeds; what the scores are depends on the learner, that they are four and lie in [0, 1] does not."""
    train, syn, _, test = _prepared(spark, sf)

    def datasets(seed):
        return {"real": train, "synthetic": bernoulli(syn, seed)}, {"test": test}

    def bernoulli(rows, seed):
        return rows.where(fraction(f"u5-{seed}", "key") < 0.8)

    forest = lambda seed: {"forest": U.learners(_width(train), 2, seed)["forest"]}
    s = U.summarize_scores(U.repeat_scores(datasets, forest, (1, 2), (1, 2), lambda p: U.evaluate(p, 2)))
    return s.select("source", "split", "metric", "count", F.col("mean").between(0, 1).alias("within"))


SCORES_SQL = "select l_returnflag as source, l_linestatus as split, cast(l_linenumber as varchar) as metric, l_discount as value from lineitem"


@query("u5_summarize_scores", f"""select source, split, metric, count(*) as count, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std
from ({SCORES_SQL}) group by all""")
def u5(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("split"),
        F.col("l_linenumber").cast("string").alias("metric"), F.col("l_discount").alias("value"))
    s = U.summarize_scores(li)
    return s.select("source", "split", "metric", "count", tidy("mean").alias("mean"), tidy("std").alias("std"))


@query("u2_confusion_scores", """with p as (select l_linenumber % 3 as a, cast(l_quantity as int) % 3 as b from lineitem),
c as (select c, (select count(*) from p where a = c) as na, (select count(*) from p where b = c) as np, (select count(*) from p where a = c and b = c) as nh from range(3) r(c)),
f as (select *, 2 * nh / (na + np)::double as f1 from c)
select round(sum(nh) / sum(na), 6) as accuracy, round(avg(f1), 6) as macro_f1, round(sum(f1 * na) / sum(na), 6) as weighted_f1 from f""")
def u2_confusion(spark, sf):
    p = table(spark, sf, "lineitem").select(
        (F.col("l_linenumber") % 3).cast("double").alias("label"), (F.col("l_quantity").cast("int") % 3).cast("double").alias("prediction"))
    s = U.class_scores(U.confusion(p))
    return s.select(*[tidy(c).alias(c) for c in s.columns])


@query("u6_discriminator")
def u6(spark, sf):
    train, syn, _, _ = _prepared(spark, sf)
    cols = ["key", U.FEATURES]
    model = U.learners(_width(train), 2)["forest"]
    return U.discriminate(model, train.select(*cols), syn.select(*cols), "key", "u6")


@query("u7_copying_test")
def u7(spark, sf):
    train, syn, _, test = _prepared(spark, sf)
    cols = ["key", U.FEATURES]
    return U.copying_test(U.learners(_width(train), 2)["forest"], train.select(*cols), test.select(*cols), syn.select(*cols), "key")


# ---- result documents -------------------------------------------------------------------

DATASETS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
EXPERIMENTS = {"F": "first", "O": "over", "P": "prior"}


def _documents(spark, sf):
    """One document per priority (dataset) and status (experiment): mean scaled price as the score; prior has no 5-LOW."""
    o = table(spark, sf, "orders")
    stat = o.groupBy(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("st")).agg(
        F.round(F.avg("o_totalprice") / 1e6, 4).alias("m"), F.count(F.lit(1)).cast("double").alias("n"),
        F.round(F.max("o_totalprice") / 1e6, 4).alias("x")).where("not (st = 'P' and dataset = '5-LOW')")
    metrics = lambda a: F.create_map(F.lit("f1-mean"), F.col(a), F.lit("f1-count"), F.col("n"), F.lit("r2-mean"), F.col(a) / 2)
    doc = F.to_json(F.create_map(
        F.lit("synthetic"), F.create_map(F.lit("val"), metrics("m"), F.lit("test"), metrics("m")),
        F.lit("real"), F.create_map(F.lit("val"), metrics("x"), F.lit("test"), metrics("x"))))
    name = F.create_map(*[F.lit(x) for kv in EXPERIMENTS.items() for x in kv])
    return stat.select("dataset", name[F.col("st")].alias("experiment"), doc.alias("value"))


DOCS_SQL = """st as (select o_orderpriority as dataset, case o_orderstatus when 'F' then 'first' when 'O' then 'over' else 'prior' end as experiment,
  round(avg(o_totalprice) / 1e6, 4) as m, count(*)::double as n, round(max(o_totalprice) / 1e6, 4) as x
  from orders group by all having not (experiment = 'prior' and dataset = '5-LOW')),
long as (select dataset, experiment, source, split, metric, stat,
  round(case when stat = 'count' then n else (case source when 'real' then x else m end) / (case metric when 'r2' then 2 else 1 end) end, 6) as value
  from st, (select unnest(['real', 'synthetic']) as source), (select unnest(['val', 'test']) as split),
  (select 'f1' as metric, 'mean' as stat union all select 'f1', 'count' union all select 'r2', 'mean'))"""


@query("s17_eval_tree", f"with {DOCS_SQL} select * from long")
def s17(spark, sf):
    root = scratch_path(spark, "s17")
    # one file per folder, as the documents are laid out
    _documents(spark, sf).repartition("dataset", "experiment").write.partitionBy("dataset", "experiment").text(root)
    rows = results.read_eval_tree(spark, f"{root}/*/*/*.txt")
    strip = lambda c: F.regexp_replace(F.url_decode(F.col(c)), "^[a-z]+=", "")
    return rows.withColumns({"dataset": strip("dataset"), "experiment": strip("experiment"), "value": tidy("value")})


METHODS = {"real": ("first", "real"), "first": ("first", "synthetic"), "over": ("over", "synthetic"), "prior": ("prior", "synthetic")}


@query("u8_result_table", f"with {DOCS_SQL}, m as (select 'real' as method, 'first' as experiment, 'real' as source union all select 'first', 'first', 'synthetic' "
       "union all select 'over', 'over', 'synthetic' union all select 'prior', 'prior', 'synthetic') select method, "
       + ", ".join(f"coalesce(max(format('{{:.4f}}', value)) filter (where dataset = '{d}'), '--') as \"{d}\"" for d in DATASETS)
       + " from m join long using (experiment, source) where split = 'test' and stat = 'mean' and metric = case when dataset = '2-HIGH' then 'r2' else 'f1' end group by method")
def u8(spark, sf):
    long = results.explode_documents(_documents(spark, sf), ["dataset", "experiment"])
    return results.result_table(long, METHODS, DATASETS, ["2-HIGH"])


