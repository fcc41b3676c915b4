"""Gradients, solver steps, rounds and weight tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from gradloom.catalog.preparation import CROPPED, byte_images, cropping_net
from gradloom.catalog.registry import EMB, Registry, r6, table
from gradloom.catalog.sampling import by_arithmetic
from gradloom.catalog.scoring import NET, PROBS, fixed_weights
from gradloom.functions.dense import learning_rate
from gradloom.functions.shapes import indexed
from gradloom.operators.means import as_array, mean_by_position
from gradloom.operators.train import LOSS, gradient, local_sgd_round, sgd_step
from gradloom.operators.weights import MOMENTUM, add_weights, average_weights, scalar_divide, weights_equal
from gradloom.operators.workers import round_window, worker_counts
from gradloom.plans.fit import fit
from gradloom.plans.net import softmax_regression
from gradloom.plans.solver import Solver
from gradloom.session import cut_lineage, shared_path
from gradloom.sources.weights import append_history, load_weights, save_weights

REGISTRY = Registry()
query = REGISTRY.query


def flat_blobs(weights, *keys):
    """One row per value: (keys..., layer, blob, pos, value)."""
    values = indexed(weights, [*keys, "layer", "blob", "chunk"], F.col("values"), "at", "v")
    return values.select(*keys, "layer", "blob", (F.col("chunk") * 4096 + F.col("at")).alias("pos"), r6("v").alias("value"))


def class_mean_weights(spark, folder, worker=None):
    """Weights derived from data: row c of layer `ip` is the mean embedding of class c.

    Checkpointed as a trained table would be; with constant keys in the plan a join on them would lose its keys.
    """
    keys = ["worker"] if worker is not None else []
    df = table(spark, folder, "embeddings").withColumns({"worker": worker} if worker is not None else {})
    means = mean_by_position(df, "embedding", [*keys, "label"]).withColumn("pos", F.col("label") * 64 + F.col("pos"))
    rows = means.groupBy(*keys).agg(as_array("pos", "mean").alias("values"))
    return cut_lineage(rows.select(*keys, F.lit("ip").alias("layer"), F.lit(0).alias("blob"),
                                   F.array(F.lit(10), F.lit(64)).alias("shape"), F.lit(0).alias("chunk"), "values"))


GRADIENT = f"""{PROBS}, onehot AS (SELECT vec_id, c, p - (c = label)::INTEGER AS d FROM p),
g AS (SELECT 0 AS blob, (c * 64 + pos)::INTEGER AS pos, avg(d * x) AS g FROM onehot JOIN emb ON onehot.vec_id = emb.vec_id
GROUP BY c, pos UNION ALL SELECT 1 AS blob, c::INTEGER AS pos, avg(d) AS g FROM onehot GROUP BY c)"""
START = """w0 AS (SELECT 0 AS blob, (c * 64 + i)::INTEGER AS pos, w FROM w UNION ALL
SELECT 1 AS blob, c::INTEGER AS pos, c / 100.0::DOUBLE AS w FROM range(10) a(c))"""


@query(f"WITH {GRADIENT} SELECT 'ip' AS layer, blob, pos, round(g, 6) + 0.0 AS value FROM g")
def gradient_full(spark, folder):
    return flat_blobs(gradient(table(spark, folder, "embeddings"), NET, fixed_weights(spark, NET)))


SOLVER = Solver(0.5, momentum=0.9, decay=0.01)


@query(f"""WITH {GRADIENT}, {START}, step AS (SELECT w0.blob AS blob, w0.pos AS pos, w, -0.5::DOUBLE * (g + 0.01::DOUBLE * w) AS v
FROM w0 JOIN g ON w0.blob = g.blob AND w0.pos = g.pos)
SELECT 'ip' AS layer, blob, pos, round(w + v, 6) + 0.0 AS value FROM step UNION ALL
SELECT 'ip/momentum' AS layer, blob, pos, round(v, 6) + 0.0 AS value FROM step""")
def sgd_step_momentum(spark, folder):
    weights = fixed_weights(spark, NET)
    grads = gradient(table(spark, folder, "embeddings"), NET, weights)
    return flat_blobs(sgd_step(weights, grads, NET, SOLVER))


WORKER_GRADIENT = f"""{PROBS}, onehot AS (SELECT vec_id, vec_id % 4 AS worker, c, p - (c = label)::INTEGER AS d FROM p),
g AS (SELECT worker, 0 AS blob, (c * 64 + pos)::INTEGER AS pos, avg(d * x) AS g FROM onehot JOIN emb ON onehot.vec_id = emb.vec_id
GROUP BY worker, c, pos UNION ALL SELECT worker, 1 AS blob, c::INTEGER AS pos, avg(d) AS g FROM onehot GROUP BY worker, c)"""


@query(f"WITH {WORKER_GRADIENT} SELECT worker::INTEGER AS worker, 'ip' AS layer, blob, pos, round(g, 6) + 0.0 AS value FROM g")
def gradient_per_worker(spark, folder):
    df = table(spark, folder, "embeddings").withColumn("worker", (F.col("vec_id") % 4).cast("int"))
    return flat_blobs(gradient(df, NET, fixed_weights(spark, NET), by=["worker"]), "worker")


@query(f"""WITH {WORKER_GRADIENT}, {START} SELECT 'ip' AS layer, w0.blob AS blob, w0.pos AS pos, round(avg(w - 0.5::DOUBLE * g), 6) + 0.0
AS value FROM w0 JOIN g ON w0.blob = g.blob AND w0.pos = g.pos GROUP BY w0.blob, w0.pos""")
def local_round_one_step(spark, folder):
    """One step per worker over all of its rows, then the average."""
    weights = fixed_weights(spark, NET)
    df = table(spark, folder, "embeddings").withColumn("worker", (F.col("vec_id") % 4).cast("int"))
    grads = gradient(df, NET, weights, by=["worker"])
    local = sgd_step(weights, grads, NET, Solver(0.5), by=["worker"])
    return flat_blobs(average_weights(local, 4))


def _rounds(rounds, state="average"):
    """SQL of rounds of two momentum steps per worker on windows of 2 x 10 rows, with the average of the weights after each."""
    parts = ["""src AS (SELECT vec_id, label, (vec_id % 4) AS worker, embedding, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) - 1
AS rn, count(*) OVER (PARTITION BY vec_id % 4) AS n FROM embeddings)"""]
    carried = {"average": "avg(v) OVER (PARTITION BY c, i)", "local": "v", "reset": "0.0::DOUBLE"}[state]
    for r in range(rounds):
        parts.append(f"""win{r} AS (SELECT vec_id, label, worker, embedding, (rn - (worker * 31 + 7 + {13 * r}) % (n - 20)) // 10 AS step FROM src
WHERE rn - (worker * 31 + 7 + {13 * r}) % (n - 20) BETWEEN 0 AND 19),
x{r} AS (SELECT vec_id, label, worker, step, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM win{r}
UNION ALL SELECT vec_id, label, worker, step, 1.0::DOUBLE AS x, 64 AS i FROM win{r})""")
        parts.append("""w0_0 AS (SELECT worker, c, i, CASE WHEN i < 64 THEN ((c * 7 + i) % 5 - 2) / 10.0::DOUBLE ELSE c / 100.0::DOUBLE END AS w, 0.0::DOUBLE AS v
FROM range(4) s(worker), range(10) a(c), range(65) b(i))""" if r == 0 else
                     f"w{r}_0 AS (SELECT worker, c, i, avg(w) OVER (PARTITION BY c, i) AS w, {carried} AS v FROM w{r - 1}_2)")
        for s in (0, 1):
            t = f"{r}_{s}"
            parts.append(f"""z{t} AS (SELECT x.worker, vec_id, label, c, sum(x * w) AS z FROM x{r} x JOIN w{t} w ON x.i = w.i AND x.worker = w.worker
WHERE step = {s} GROUP BY x.worker, vec_id, label, c),
e{t} AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z{t}),
d{t} AS (SELECT worker, vec_id, c, e / sum(e) OVER (PARTITION BY vec_id) - (c = label)::INTEGER AS d FROM e{t}),
g{t} AS (SELECT d.worker, c, i, avg(d * x) AS g FROM d{t} d JOIN x{r} x ON d.vec_id = x.vec_id GROUP BY d.worker, c, i),
w{r}_{s + 1} AS (SELECT w.worker, w.c, w.i, w + 0.9::DOUBLE * v - 0.5::DOUBLE * (g + 0.01::DOUBLE * w) AS w,
0.9::DOUBLE * v - 0.5::DOUBLE * (g + 0.01::DOUBLE * w) AS v FROM w{t} w JOIN g{t} g ON w.worker = g.worker AND w.c = g.c AND w.i = g.i)""")
    return "WITH " + ", ".join(parts) + f""" SELECT 'ip' AS layer, (i = 64)::INTEGER AS blob,
(CASE WHEN i < 64 THEN c * 64 + i ELSE c END)::INTEGER AS pos, round(avg(w), 6) + 0.0 AS value FROM w{rounds - 1}_2 GROUP BY c, i"""


@query(_rounds(1))
def local_round_two_steps(spark, folder):
    """A round of two momentum steps on each worker's window, then the average."""
    df = by_arithmetic(table(spark, folder, "embeddings"))
    start = (F.col("worker") * 31 + 7) % (F.col("worker_rows") - 20)
    window = round_window(df, worker_counts(df), 2, 10, 0, start=start)
    local = local_sgd_round(window, fixed_weights(spark, NET), NET, SOLVER, 4, 2, 10)
    merged = average_weights(local, 4)
    return flat_blobs(merged.filter(~F.col("layer").endswith(MOMENTUM) & (F.col("layer") != LOSS)))


@query(f"""WITH {CROPPED},
src AS (SELECT vec_id, (vec_id % 4) AS worker, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) - 1 AS rn, count(*) OVER (PARTITION BY vec_id % 4) AS n FROM embeddings),
win AS (SELECT vec_id, worker FROM src WHERE rn - (worker * 31 + 7) % (n - 10) BETWEEN 0 AND 9),
x AS (SELECT vec_id, worker, label, c * 6 + r * 2 + q AS i, x / 1 AS x FROM crops JOIN win USING (vec_id) WHERE round = 2
UNION ALL SELECT vec_id, worker, label, 24 AS i, 1.0::DOUBLE AS x FROM win JOIN embeddings USING (vec_id)),
w AS (SELECT c, i, CASE WHEN i < 24 THEN ((c * 7 + i) % 5 - 2) / 10.0::DOUBLE ELSE c / 100.0::DOUBLE END AS w FROM range(10) a(c), range(25) b(i)),
z AS (SELECT worker, vec_id, label, c, sum(x * w) AS z FROM x JOIN w ON x.i = w.i GROUP BY worker, vec_id, label, c),
e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z),
d AS (SELECT worker, vec_id, c, e / sum(e) OVER (PARTITION BY vec_id) - (c = label)::INTEGER AS d FROM e),
g AS (SELECT d.worker, c, i, avg(d * x) AS g FROM d JOIN x ON d.vec_id = x.vec_id GROUP BY d.worker, c, i)
SELECT 'ip' AS layer, (w.i = 24)::INTEGER AS blob, (CASE WHEN w.i < 24 THEN w.c * 24 + w.i ELSE w.c END)::INTEGER AS pos,
round(avg(w - 0.001::DOUBLE * g), 6) + 0.0 AS value FROM w JOIN g ON w.c = g.c AND w.i = g.i GROUP BY w.c, w.i""")
def crop_round_step(spark, folder):
    """A step of four workers in round 2 on byte images: mean subtracted and cropped inside the batch, then the average of the weights."""
    images = byte_images(spark, folder)
    net = cropping_net(images)
    df = by_arithmetic(images)
    window = round_window(df, worker_counts(df), 1, 10, 2, start=(F.col("worker") * 31 + 7) % (F.col("worker_rows") - 10))
    local = local_sgd_round(window, fixed_weights(spark, net), net, Solver(0.001), 4, 1, 10, round_no=2)
    return flat_blobs(average_weights(local, 4).filter(F.col("layer") != LOSS))


LINEITEM_NET = softmax_regression(4, 3, data="features")


@query("""WITH f AS (SELECT row_number() OVER () AS id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label,
[l_quantity / 50, l_extendedprice / 105000, l_discount * 10, l_tax * 10, 1.0] AS features FROM lineitem),
w0 AS (SELECT c, i, CASE WHEN i < 4 THEN ((c * 7 + i) % 5 - 2) / 10.0::DOUBLE ELSE c / 100.0::DOUBLE END AS w FROM range(3) a(c), range(5) b(i)),
x AS (SELECT id, label, unnest(features)::DOUBLE AS x, generate_subscripts(features, 1) - 1 AS i FROM f),
z AS (SELECT id, label, c, sum(x * w) AS z FROM x JOIN w0 ON x.i = w0.i GROUP BY id, label, c),
e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY id)) AS e FROM z),
d AS (SELECT id, c, e / sum(e) OVER (PARTITION BY id) - (c = label)::INTEGER AS d FROM e),
g AS (SELECT c, i, avg(d * x) AS g FROM d JOIN x ON d.id = x.id GROUP BY c, i)
SELECT 'ip' AS layer, (w0.i = 4)::INTEGER AS blob, (CASE WHEN w0.i < 4 THEN w0.c * 4 + w0.i ELSE w0.c END)::INTEGER AS pos,
round(w - 0.5::DOUBLE * g, 6) + 0.0 AS value FROM w0 JOIN g ON w0.c = g.c AND w0.i = g.i""")
def lineitem_train_step(spark, folder):
    """One full-batch step on scaled line items with the return flag as label."""
    df = table(spark, folder, "lineitem").select(
        F.array(F.col("l_quantity") / 50, F.col("l_extendedprice") / 105000, F.col("l_discount") * 10,
                F.col("l_tax") * 10).alias("features"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("label"))
    weights = fixed_weights(spark, LINEITEM_NET)
    return flat_blobs(sgd_step(weights, gradient(df, LINEITEM_NET, weights, batch=8192), LINEITEM_NET, Solver(0.5)))


WORKER_MEANS = f"""{EMB}, m AS (SELECT vec_id % 2 AS worker, label, pos, avg(x) AS v FROM emb GROUP BY vec_id % 2, label, pos)"""


def _worker_means(spark, folder):
    return class_mean_weights(spark, folder, (F.col("vec_id") % 2).cast("int"))


@query(f"""WITH {WORKER_MEANS} SELECT 'ip' AS layer, 0 AS blob, (label * 64 + pos)::INTEGER AS pos, round(avg(v), 6) + 0.0 AS value
FROM m GROUP BY label, pos""")
def weights_average(spark, folder):
    """The mean of two workers' class means."""
    return flat_blobs(average_weights(_worker_means(spark, folder), 2))


@query(f"""WITH {WORKER_MEANS} SELECT 'ip' AS layer, 0 AS blob, (label * 64 + pos)::INTEGER AS pos, round(sum(v) / 3, 6) + 0.0 AS value
FROM m GROUP BY label, pos""")
def weights_add_divide(spark, folder):
    local = _worker_means(spark, folder)
    a, b = (local.filter(F.col("worker") == w).drop("worker") for w in (0, 1))
    return flat_blobs(scalar_divide(add_weights(a, b), 3))


@query(f"""WITH {EMB}, m AS (SELECT label, pos, avg(x) AS v FROM emb GROUP BY label, pos)
SELECT 'ip' AS layer, 0 AS blob, (label * 64 + pos)::INTEGER AS pos, round(v, 6) + 0.0 AS value FROM m""")
def weights_saved(spark, folder):
    """Class means saved as weights and loaded back."""
    path = shared_path(spark, "saved")
    save_weights(class_mean_weights(spark, folder), path)
    return flat_blobs(load_weights(spark, path))


@query(f"""WITH {EMB}, m AS (SELECT label, pos, avg(x) AS v FROM emb GROUP BY label, pos)
SELECT 'ip' AS layer, 0 AS blob, (label * 64 + pos)::INTEGER AS pos, round(v, 6) + 0.0 AS value FROM m
UNION ALL SELECT 'ip' AS layer, 1 AS blob, c::INTEGER AS pos, c / 100.0::DOUBLE AS value FROM range(10) a(c)""")
def weights_saved_by_name(spark, folder):
    """A net takes its own layers from saved weights, by name; others are left alone."""
    path = shared_path(spark, "saved")
    means = class_mean_weights(spark, folder)
    bias = fixed_weights(spark, NET).filter("blob = 1")
    save_weights(means.unionByName(bias).unionByName(means.withColumn("layer", F.lit("other"))), path)
    return flat_blobs(load_weights(spark, path, NET))


@query("""SELECT (o_orderkey % 7)::INTEGER AS round, 'price' AS metric, count(*) AS entries, round(sum(o_totalprice), 2) + 0.0 AS total
FROM orders GROUP BY o_orderkey % 7""")
def history_appended(spark, folder):
    """History rows written in two batches and read together; the orders stand for metrics."""
    path = shared_path(spark, "history")
    orders = table(spark, folder, "orders")
    rows = orders.select((F.col("o_orderkey") % 7).cast("int").alias("round"), F.col("o_orderkey").cast("double").alias("elapsed_s"),
                         F.lit("price").alias("metric"), F.col("o_totalprice").cast("double").alias("value"))
    append_history(rows.filter("round < 3"), path)
    append_history(rows.filter("round >= 3"), path)
    return spark.read.parquet(path).groupBy("round", "metric").agg(F.count(F.lit(1)).alias("entries"), (F.round(F.sum("value"), 2) + 0.0).alias("total"))


@query(f"""WITH {WORKER_MEANS} SELECT t.tolerance AS tolerance, bool_and(abs(a.v - b.v) <= t.tolerance) AS equal FROM m a JOIN m b
ON a.label = b.label AND a.pos = b.pos AND a.worker = 0 AND b.worker = 1, (SELECT unnest([0.0001, 1.0])::DOUBLE AS tolerance) t GROUP BY t.tolerance""")
def weights_equal_within(spark, folder):
    local = _worker_means(spark, folder)
    a, b = (local.filter(F.col("worker") == w).drop("worker") for w in (0, 1))
    checks = [weights_equal(a, b, t).select(F.lit(t).alias("tolerance"), "equal") for t in (0.0001, 1.0)]
    return checks[0].unionByName(checks[1])


@query("""SELECT o_orderkey AS step, round(0.01 * pow(0.95, floor(o_orderkey * 64 / 60000)), 10) + 0.0 AS decayed,
round(0.01 * pow(0.1, floor(o_orderkey / 4000)), 10) + 0.0 AS stepped, 0.001::DOUBLE AS fixed FROM orders""")
def lr_schedule(spark, folder):
    """Learning rates with the order key as the step."""
    step = F.col("o_orderkey")
    ten = lambda c: F.round(c, 10) + F.lit(0.0)
    return table(spark, folder, "orders").select(
        step.alias("step"),
        ten(learning_rate(step, "exponential", 0.01, batch=64, decay_rate=0.95, decay_samples=60000)).alias("decayed"),
        ten(learning_rate(step, "step", 0.01, gamma=0.1, step_size=4000)).alias("stepped"),
        learning_rate(step, "fixed", 0.001).alias("fixed"))


def _fit(spark, folder, state):
    df = cut_lineage(by_arithmetic(table(spark, folder, "embeddings")))
    solver = Solver(0.5, momentum=0.9, decay=0.01, momentum_state=state)
    start = lambda round_no: (F.col("worker") * 31 + 7 + 13 * round_no) % (F.col("worker_rows") - 20)
    return flat_blobs(fit(df, NET, solver, rounds=2, tau=2, batch=10, weights=fixed_weights(spark, NET), start=start).weights)


@query(_rounds(2))
def fit_rounds(spark, folder):
    """Two rounds of two steps on four workers; the momentum is averaged with the weights."""
    return _fit(spark, folder, "average")


EVALUATED = _rounds(1).split(" SELECT 'ip' AS layer")[0] + f""", weights AS (SELECT 0 AS round, c, i, w FROM w0_0 WHERE worker = 0
UNION ALL SELECT 1 AS round, c, i, avg(w) AS w FROM w0_2 GROUP BY c, i),
kept AS (SELECT vec_id, label FROM src WHERE rn < n // 15 * 15),
xs AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings JOIN kept USING (vec_id, label)
UNION ALL SELECT vec_id, label, 1.0::DOUBLE AS x, 64 AS i FROM kept),
zs AS (SELECT round, vec_id, label, c, sum(x * w) AS z FROM xs JOIN weights ON xs.i = weights.i GROUP BY round, vec_id, label, c),
rows_ AS (SELECT round, vec_id, (arg_max(c, z) = any_value(label))::INTEGER AS hit, ln(sum(exp(z - m))) + any_value(m) - max(CASE WHEN c = label THEN z END) AS loss
FROM (SELECT *, max(z) OVER (PARTITION BY round, vec_id) AS m FROM zs) GROUP BY round, vec_id)
SELECT round::INTEGER AS round, 'accuracy' AS metric, round(avg(hit), 6) + 0.0 AS value FROM rows_ GROUP BY round
UNION ALL SELECT round::INTEGER AS round, 'test_loss' AS metric, round(avg(loss), 6) + 0.0 AS value FROM rows_ GROUP BY round"""


@query(EVALUATED)
def fit_rounds_evaluated(spark, folder):
    """What the history of two rounds says of a test table of four workers, over full minibatches of 15 rows, before each round."""
    df = cut_lineage(by_arithmetic(table(spark, folder, "embeddings")))
    start = lambda round_no: (F.col("worker") * 31 + 7 + 13 * round_no) % (F.col("worker_rows") - 20)
    result = fit(df, NET, SOLVER, rounds=2, tau=2, batch=10, weights=fixed_weights(spark, NET), start=start, test=df, eval_every=1, test_batch=15)
    return result.history.where("metric <> 'loss'").select("round", "metric", r6("value").alias("value"))


@query(_rounds(2, "local"))
def fit_rounds_local_momentum(spark, folder):
    return _fit(spark, folder, "local")


@query(_rounds(2, "reset"))
def fit_rounds_reset_momentum(spark, folder):
    return _fit(spark, folder, "reset")
