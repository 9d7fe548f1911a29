"""Parts the checking SQL is put together from.

The SQL computes every result on its own: labels, hidden layers, sums, and for
the fits a Gauss-Jordan solution of the normal equations as a recursive query.
"""

from __future__ import annotations

from sensorlab.schema import CHANNELS, LABEL
from sensorlab.sources.adapters import READING_SQL, SUBJECT_SQL

_READING_COLUMNS = ", ".join(f"{READING_SQL[c]} AS {c}" for c in CHANNELS + [LABEL])

READINGS = (
    f"readings AS (SELECT CAST({SUBJECT_SQL} AS BIGINT) AS subject, l_orderkey AS session_id, "
    f"{_READING_COLUMNS} FROM lineitem)"
)
_BINARY = f"CAST(CASE WHEN {LABEL} BETWEEN 1 AND 3 THEN 0 ELSE 1 END AS DOUBLE) AS binaryLabel"
LABELLED = READINGS + f", labelled AS (SELECT *, {_BINARY} FROM readings WHERE {LABEL} > 0)"
VECTORS = (
    "vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, "
    f"CAST(label AS DOUBLE) AS {LABEL} FROM embeddings)"
)
LABELLED_VECTORS = VECTORS + f", labelled AS (SELECT *, {_BINARY} FROM vectors WHERE {LABEL} > 0)"


def knuth(key: str, seed: int = 0) -> str:
    """The 32-bit hash of a key below 2^31."""
    return f"((({key}) + {seed}) * 2654435761 % 4294967296)"


def knuth_twice(key: str, seed: int = 0) -> str:
    h = f"xor(CAST({knuth(key, seed)} AS BIGINT), CAST({knuth(key, seed)} AS BIGINT) >> 16)"
    return f"((({h} % 2147483648) * 2654435761 + ({h} // 2147483648) * 1103515245) % 4294967296)"


def rounded(expression: str, digits: int) -> str:
    """Rounded, with no negative zero."""
    return f"round({expression}, {digits}) + 0.0"


def lattice(first: str, count: int, name: str) -> str:
    """One row with a list ``w`` of arithmetic numbers for k = first .. first + count - 1."""
    return (
        f"{name} AS (SELECT list(CAST((a * a) % 2147483647 AS DOUBLE) / 2147483647 ORDER BY k) AS w "
        f"FROM (SELECT k, (1103515245 * k + 12345) % 2147483648 AS a "
        f"FROM (SELECT {first} + range AS k FROM range({count}))))"
    )


def layer(nodes: int, features: int, name: str = "layer") -> str:
    """Weights and bias of an arithmetic layer, node by node, the bias first."""
    return lattice("0", nodes * (features + 1), name)


def activation(name: str, z: str) -> str:
    return {
        "sigmoid": f"(1.0 / (1.0 + exp(-({z}))))",
        "tanh": f"tanh({z})",
        "sin": f"sin({z})",
        "radbas": f"exp(-(({z}) * ({z})))",
        "hardlim": f"CAST(CASE WHEN ({z}) >= 0 THEN 1 ELSE 0 END AS DOUBLE)",
        "linear": f"({z})",
    }[name]


def node_inputs(features: list[str], nodes: int, weights: str = "layer.w") -> list[str]:
    """Weighted input of each node; lists count from 1."""
    width = len(features) + 1
    result = []
    for n in range(nodes):
        start = n * width + 1
        terms = [f"{weights}[{start}]"]
        terms += [f"{weights}[{start + 1 + f}] * {x}" for f, x in enumerate(features)]
        result.append(" + ".join(terms))
    return result


def hidden(
    rows: str, keep: list[str], features: list[str], nodes: int, act: str, name: str = "hidden"
) -> str:
    """Kept columns and hidden outputs h1 .. hn of each row."""
    columns = keep + [
        f"{activation(act, z)} AS h{n + 1}" for n, z in enumerate(node_inputs(features, nodes))
    ]
    return f"{name} AS (SELECT {', '.join(columns)} FROM {rows}, layer)"


def normal_rows(source: str, nodes: int, target: str, name: str, where: str = "TRUE") -> str:
    """Rows (i, r) of the normal equations, the right side last in the list r."""
    upper = {
        (i, j): f"sum(h{i} * h{j}) AS g{i}_{j}"
        for i in range(1, nodes + 1)
        for j in range(i, nodes + 1)
    }
    right = [f"sum(h{i} * {target}) AS g{i}_y" for i in range(1, nodes + 1)]
    sums = f"SELECT {', '.join([*upper.values(), *right])} FROM {source} WHERE {where}"
    lists = []
    for i in range(1, nodes + 1):
        cells = [f"g{min(i, j)}_{max(i, j)}" for j in range(1, nodes + 1)] + [f"g{i}_y"]
        lists.append(f"SELECT {i} AS i, [{', '.join(cells)}] AS r FROM {name}_sums")
    return f"{name}_sums AS ({sums}), {name} AS ({' UNION ALL '.join(lists)})"


def gauss_jordan(source: str, n: int, name: str, right: int = 1) -> str:
    """Solve n equations given as rows (i, r); one row with a list ``b`` of the
    solution, or with ``right`` > 1 one list per equation."""
    width = n + right
    scaled = ", ".join(f"a.r[{k}] / a.r[a.i]" for k in range(1, width + 1))
    reduced = ", ".join(
        f"a.r[{k}] - a.r[p.i] * p.r[{k}] / p.r[p.i]" for k in range(1, width + 1)
    )
    steps = (
        f"{name}_steps AS (SELECT 0 AS step, i, r FROM {source} UNION ALL "
        f"SELECT a.step + 1, a.i, CASE WHEN a.i = p.i THEN [{scaled}] ELSE [{reduced}] END "
        f"FROM {name}_steps a JOIN {name}_steps p ON p.i = a.step + 1 WHERE a.step < {n})"
    )
    if right == 1:
        answer = f"SELECT list(r[{width}] ORDER BY i) AS b FROM {name}_steps WHERE step = {n}"
    else:
        answer = f"SELECT i, r[{n + 1}:{width}] AS b FROM {name}_steps WHERE step = {n}"
    return f"{steps}, {name} AS ({answer})"


def weighted(nodes: int, weights: str = "beta.b") -> str:
    """Network output from hidden columns and output weights."""
    return " + ".join(f"{weights}[{i}] * h{i}" for i in range(1, nodes + 1))


def fitted_network(
    tables: str, rows: str, keep: list[str], features: list[str], nodes: int, act: str,
    target: str = "binaryLabel", train: str = "TRUE",
) -> str:
    """WITH list that ends in ``scored``: kept columns and the fitted output t."""
    parts = [
        tables,
        layer(nodes, len(features)),
        hidden(rows, keep, features, nodes, act),
        normal_rows("hidden", nodes, target, "equations", train),
        gauss_jordan("equations", nodes, "beta"),
        f"scored AS (SELECT hidden.*, {weighted(nodes)} AS t FROM hidden, beta)",
    ]
    return "WITH RECURSIVE " + ", ".join(parts) + " "


def ranked_area(source: str, score: str, label: str) -> str:
    """Area under the ROC curve by mid-ranks (Mann-Whitney)."""
    return (
        f"SELECT (sum(CASE WHEN y = 1 THEN mid ELSE 0 END) - p * (p + 1) / 2.0) / (p * n) AS area "
        f"FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 "
        f"AS mid, sum(y) OVER () AS p, sum(1 - y) OVER () AS n "
        f"FROM (SELECT {score} AS s, {label} AS y FROM {source})) GROUP BY p, n"
    )
