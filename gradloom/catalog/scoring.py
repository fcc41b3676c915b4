"""Forward passes, predictions and metrics of nets with fixed weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradloom.catalog.registry import EMB, Registry, elements, r6, table
from gradloom.catalog.sampling import by_arithmetic
from gradloom.functions.dense import argmax, dense, percent, relu, softmax, softmax_loss
from gradloom.functions.fill import BELOW_TWO, MIDDLE, TAIL, TAILS
from gradloom.operators.evaluate import accuracy, batch_accuracy
from gradloom.operators.samples import widen, with_scalar
from gradloom.operators.score import evaluate, featurize, forward
from gradloom.operators.weights import blob_values, init_weights, l2_term, matrix_rows, weights_from_dict
from gradloom.plans import net as n
from gradloom.plans.presets import cifar_net
from gradloom.session import shuffle_partitions

REGISTRY = Registry()
query = REGISTRY.query

NET = n.softmax_regression(64, 10, data="embedding")
HIDDEN = n.Net("two_layers", (n.Input("embedding", (64,)), n.Input("label", label=True)), (
    n.dense("ip1", "embedding", 16), n.relu("relu1", "ip1"), n.dense("ip2", "ip1", 10), n.softmax("prob", "ip2"),
    n.accuracy("accuracy", "ip2"), n.softmax_loss("loss", "ip2")))
CONV = n.Net("conv", (n.Input("embedding", (1, 8, 8)),), (
    n.conv("conv1", "embedding", 2, 3, pad=1), n.pool("pool1", "conv1", "max", 2, 2), n.relu("relu1", "pool1"),
    n.pool("pool2", "pool1", "ave", 2, 2), n.dropout("drop", "pool2"), n.Layer("reshape", "flat", ("pool2",), "flat")))


def rule(net):
    """Fixed weights: `((c * 7 + i) % 5 - 2) / 10` for output c and input i, biases `c / 100`."""
    inputs = {p.layer: p.size // p.shape[0] for p in net.params() if p.blob == 0}
    return n.weights_by_rule(net, lambda layer, blob, at: at / 100 if blob else (
        (at // inputs[layer] * 7 + at % inputs[layer]) % 5 - 2) / 10)


def fixed_weights(spark, net):
    return weights_from_dict(spark, rule(net))


WEIGHTS = """w AS (SELECT c, i, ((c * 7 + i) % 5 - 2) / 10.0::DOUBLE AS w FROM range(10) a(c), range(64) b(i))"""
LOGITS = f"""{EMB}, {WEIGHTS}, z AS (SELECT vec_id, label, c, sum(x * w) + c / 100.0::DOUBLE AS z FROM emb JOIN w ON i = pos
GROUP BY vec_id, label, c)"""
PROBS = LOGITS + """, e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z),
p AS (SELECT vec_id, label, c, z, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e)"""
PRED = LOGITS + """, pred AS (SELECT vec_id, any_value(label) AS label, arg_max(c, z)::INTEGER AS prediction FROM z GROUP BY vec_id)"""


def logits(spark, folder):
    """(vec_id, label, z): the dense layer as a column expression over weights attached by scalar subqueries."""
    weights = fixed_weights(spark, NET)
    df = table(spark, folder, "embeddings")
    df = with_scalar(df, "w", matrix_rows(weights, "ip", 10, 64))
    df = with_scalar(df, "b", blob_values(weights, "ip", 1))
    return df.select("vec_id", "label", dense(F.col("embedding"), F.col("w"), F.col("b")).alias("z"))


def scored(spark, folder, blob, keep=("vec_id",)):
    """The same through batches of NumPy."""
    return forward(table(spark, folder, "embeddings"), NET, fixed_weights(spark, NET), [blob], keep, element="double")


DENSE = f"WITH {LOGITS} SELECT vec_id, c::INTEGER AS pos, round(z, 6) + 0.0 AS value FROM z"
SOFTMAX = f"WITH {PROBS} SELECT vec_id, c::INTEGER AS pos, round(p, 6) + 0.0 AS value FROM p"
PREDICT = f"WITH {PRED} SELECT vec_id, prediction FROM pred"
ACCURACY = f"WITH {PRED} SELECT round(avg((prediction = label)::INTEGER), 6) + 0.0 AS accuracy, count(*) AS n FROM pred"


@query(DENSE)
def dense_forward(spark, folder):
    return elements(logits(spark, folder), ["vec_id"], F.col("z"))


@query(DENSE)
def dense_forward_batched(spark, folder):
    return elements(scored(spark, folder, "ip"), ["vec_id"], F.col("ip"))


@query(SOFTMAX)
def softmax_native(spark, folder):
    return elements(logits(spark, folder), ["vec_id"], softmax(F.col("z")))


@query(SOFTMAX)
def softmax_batched(spark, folder):
    return elements(scored(spark, folder, "prob"), ["vec_id"], F.col("prob"))


@query(PREDICT)
def predict(spark, folder):
    return logits(spark, folder).select("vec_id", argmax(F.col("z")).alias("prediction"))


@query(PREDICT)
def predict_batched(spark, folder):
    return scored(spark, folder, "prob").select("vec_id", argmax(F.col("prob")).alias("prediction"))


@query(ACCURACY)
def accuracy_native(spark, folder):
    return _rounded(accuracy(logits(spark, folder), argmax(F.col("z")), F.col("label")), "accuracy")


@query(ACCURACY)
def accuracy_batched(spark, folder):
    df = scored(spark, folder, "ip", ["label"])
    return _rounded(accuracy(df, argmax(F.col("ip")), F.col("label")), "accuracy")


def _rounded(df, *names):
    return df.withColumns({name: r6(name) for name in names})


@query(f"WITH {PRED} SELECT printf('%.2f', 100 * avg((prediction = label)::INTEGER)) AS shown FROM pred")
def accuracy_percent(spark, folder):
    df = accuracy(logits(spark, folder), argmax(F.col("z")), F.col("label"))
    return df.select(percent(F.col("accuracy")).alias("shown"))


@query(f"""WITH {PRED}, b AS (SELECT vec_id % 4 AS worker, prediction = label AS hit, row_number() OVER (PARTITION BY vec_id % 4
ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY vec_id % 4) AS n FROM pred),
per AS (SELECT worker, pos // 30 AS batch, avg(hit::INTEGER) AS acc FROM b WHERE pos // 30 < n // 30 GROUP BY worker, pos // 30)
SELECT round(sum(acc) / count(*), 6) + 0.0 AS accuracy, count(*) AS batches FROM per""")
def accuracy_by_batches(spark, folder):
    df = forward(by_arithmetic(table(spark, folder, "embeddings")), NET, fixed_weights(spark, NET), ["ip"],
                 ["worker", "pos", "worker_rows", "label"], element="double")
    return _rounded(batch_accuracy(df, argmax(F.col("ip")), F.col("label"), 30), "accuracy")


@query(f"WITH {PROBS} SELECT vec_id, round(-ln(p), 6) + 0.0 AS loss FROM p WHERE c = label")
def softmax_loss_rows(spark, folder):
    return logits(spark, folder).select("vec_id", r6(softmax_loss(F.col("z"), F.col("label"))).alias("loss"))


@query(f"""WITH {PROBS} SELECT round(avg((c = top)::INTEGER), 6) + 0.0 AS accuracy, round(avg(-ln(p)), 6) + 0.0 AS loss, count(*) AS n
FROM (SELECT *, arg_max(c, z) OVER (PARTITION BY vec_id) AS top FROM p) WHERE c = label""")
def evaluation(spark, folder):
    return _rounded(evaluate(table(spark, folder, "embeddings"), NET, fixed_weights(spark, NET)), "accuracy", "loss")


@query(f"""WITH {EMB}, m AS (SELECT label, pos, avg(x) AS v FROM emb GROUP BY label, pos)
SELECT round(5e-4::DOUBLE * sum(v * v) / 2, 9) + 0.0 AS l2 FROM m""")
def l2_of_class_means(spark, folder):
    """The L2 term of weights that are the class means."""
    from gradloom.catalog.training import class_mean_weights
    return l2_term(class_mean_weights(spark, folder), {"ip": 5e-4}).select((F.round("l2", 9) + 0.0).alias("l2"))


HIDDEN_SQL = f"""WITH {EMB}, w AS (SELECT c, i, ((c * 7 + i) % 5 - 2) / 10.0::DOUBLE AS w FROM range(16) a(c), range(64) b(i))
SELECT vec_id, c::INTEGER AS pos, round(greatest(sum(x * w) + c / 100.0::DOUBLE, 0), 6) + 0.0 AS value
FROM emb JOIN w ON i = pos GROUP BY vec_id, c"""


@query(HIDDEN_SQL)
def featurize_hidden(spark, folder):
    df = featurize(table(spark, folder, "embeddings"), HIDDEN, fixed_weights(spark, HIDDEN), "ip1", ["vec_id"], element="double")
    return elements(df, ["vec_id"], F.col("ip1"))


@query(HIDDEN_SQL)
def featurize_hidden_native(spark, folder):
    weights = fixed_weights(spark, HIDDEN)
    df = with_scalar(table(spark, folder, "embeddings"), "w", matrix_rows(weights, "ip1", 16, 64))
    df = with_scalar(df, "b", blob_values(weights, "ip1", 1))
    return elements(df, ["vec_id"], relu(dense(F.col("embedding"), F.col("w"), F.col("b"))))


CONV_SQL = f"""WITH {EMB}, k AS (SELECT o, dr, dc, ((o * 7 + (dr + 1) * 3 + dc + 1) % 5 - 2) / 10.0::DOUBLE AS w
FROM range(2) a(o), (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc)),
conv AS (SELECT vec_id, o, pos // 8 - dr AS r, pos % 8 - dc AS c, sum(x * w) + o / 100.0::DOUBLE AS y FROM emb, k
GROUP BY vec_id, o, pos // 8 - dr, pos % 8 - dc),
inside AS (SELECT * FROM conv WHERE r BETWEEN 0 AND 7 AND c BETWEEN 0 AND 7),
pool1 AS (SELECT vec_id, o, r // 2 AS r, c // 2 AS c, greatest(max(y), 0) AS y FROM inside GROUP BY vec_id, o, r // 2, c // 2),
pool2 AS (SELECT vec_id, o, r // 2 AS r, c // 2 AS c, avg(y) AS y FROM pool1 GROUP BY vec_id, o, r // 2, c // 2)
"""


@query(CONV_SQL + "SELECT vec_id, (o * 64 + r * 8 + c)::INTEGER AS pos, round(y, 6) + 0.0 AS value FROM inside")
def convolution(spark, folder):
    df = featurize(table(spark, folder, "embeddings"), CONV, fixed_weights(spark, CONV), "conv1", ["vec_id"], element="double")
    return elements(df, ["vec_id"], F.col("conv1"))


@query(CONV_SQL + "SELECT vec_id, (o * 16 + r * 4 + c)::INTEGER AS pos, round(y, 6) + 0.0 AS value FROM pool1")
def max_pooling_relu(spark, folder):
    df = featurize(table(spark, folder, "embeddings"), CONV, fixed_weights(spark, CONV), "pool1", ["vec_id"], element="double")
    return elements(df, ["vec_id"], F.col("pool1"))


@query(CONV_SQL + "SELECT vec_id, (o * 4 + r * 2 + c)::INTEGER AS pos, round(y, 6) + 0.0 AS value FROM pool2")
def average_pooling_flat(spark, folder):
    """Through dropout, which does nothing when scoring, and a reshape."""
    df = featurize(table(spark, folder, "embeddings"), CONV, fixed_weights(spark, CONV), "flat", ["vec_id"], element="double")
    return elements(df, ["vec_id"], F.col("flat"))


DRAWN = n.Net("drawn", (n.Input("embedding", (64,)),), (
    n.dense("even", "embedding", 3, fillers=(n.Filler("xavier"), n.Filler("constant", value=0.1))),
    n.dense("bell", "embedding", 3, fillers=(n.Filler("gaussian", std=0.5), n.Filler("gaussian", std=2.0))),
    n.dense("cut", "embedding", 3, fillers=(n.Filler("truncated", std=0.1), n.Filler("truncated", std=0.1)))))


def _horner(factors, x):
    text = f"({factors[0]!r}::DOUBLE)"
    for factor in factors[1:]:
        text = f"({text} * {x} + ({factor!r}::DOUBLE))"
    return text


DRAWN_SQL = f"""WITH {EMB}, place AS (SELECT layer, c, i, '5/' || layer || '/' || CASE WHEN i < 64 THEN '0/' || (c * 64 + i) ELSE '1/' || c END AS name
FROM (SELECT unnest(['even', 'bell', 'cut']) AS layer), range(3) a(c), range(65) b(i)),
drawn AS (SELECT *, (('0x' || substr(md5(name), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656::DOUBLE AS u FROM place),
share AS (SELECT *, CASE layer WHEN 'cut' THEN {BELOW_TWO!r}::DOUBLE + u * ({1 - 2 * BELOW_TWO!r}::DOUBLE) ELSE u END AS p FROM drawn),
half AS (SELECT *, p - 0.5::DOUBLE AS q, (p - 0.5::DOUBLE) * (p - 0.5::DOUBLE) AS q2, sqrt(-2::DOUBLE * ln(least(p, 1::DOUBLE - p))) AS t FROM share),
deviate AS (SELECT *, CASE WHEN p BETWEEN {TAIL} AND 1 - {TAIL} THEN {_horner(MIDDLE[0], 'q2')} * q / {_horner(MIDDLE[1], 'q2')}
ELSE (CASE WHEN p < 0.5 THEN 1 ELSE -1 END) * {_horner(TAILS[0], 't')} / {_horner(TAILS[1], 't')} END AS z FROM half),
w AS (SELECT layer, c, i, CASE layer WHEN 'even' THEN CASE WHEN i < 64 THEN (2 * u - 1) * sqrt(3 / 64::DOUBLE) ELSE 0.1 END
WHEN 'bell' THEN CASE WHEN i < 64 THEN 0.5 * z ELSE 2 * z END ELSE 0.1 * z END AS w FROM deviate),
x AS (SELECT vec_id, pos AS i, x FROM emb UNION ALL SELECT vec_id, 64 AS i, 1.0::DOUBLE AS x FROM embeddings)
SELECT vec_id, layer, c::INTEGER AS pos, round(sum(x * w), 6) + 0.0 AS value FROM x JOIN w ON x.i = w.i GROUP BY vec_id, layer, c"""


@query(DRAWN_SQL)
def initial_weights_forward(spark, folder):
    """Layers with drawn weights of every filler: xavier, gaussian, truncated, constant."""
    df = forward(table(spark, folder, "embeddings"), DRAWN, init_weights(spark, DRAWN, 5), ["even", "bell", "cut"], ["vec_id"], element="double")
    parts = [elements(df, ["vec_id"], F.col(layer)).withColumn("layer", F.lit(layer)) for layer in ("even", "bell", "cut")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(None)
def featurize_cifar(spark, folder):
    """The image net's `ip1` activations of tiled embeddings, with drawn initial weights."""
    df = widen(table(spark, folder, "embeddings"), shuffle_partitions(spark)).select("vec_id", F.flatten(F.array_repeat("embedding", 48)).alias("data"))
    net = cifar_net()
    return featurize(df, net, init_weights(spark, net, seed=1), "ip1", ["vec_id"], batch=100)
