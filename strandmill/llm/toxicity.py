"""Toxicity scoring by weak supervision.

Voters are a fixed lexicon, fixed patterns, and words and word beginnings that are mined from labelled rows. On a bounded
sample of labelled rows a generative label model is fitted by expectation maximisation. Given the class, a voter fires with
a probability that depends on whether its parent fires, the voter it is most correlated with given the class, if that
improves the Bayesian information criterion; so what correlated voters say together isn't counted twice. The observed
label takes part as one more voter. All probabilities are estimated, the label's too. A linear classifier on word features is then trained on the posterior labels, and scores every whole text.

Labels are learned only from rows whose crc32 of the doc_id as text isn't divisible by 5. At most ``SAMPLE`` labelled rows
are used, the first by hash of the doc_id; the sample alone is bounded, all documents are scored. There is no cap on voters
or features: they are all that show the evidence asked for.

Defined cases: null, empty and wordless texts have no features and get the score of the intercept. A null doc_id counts
as held out. Repeated rows are scored each for itself; of rows that share a labelled doc_id the least text is learned from.
Labels that are null, or contradict each other for a doc_id, are not used. Without any usable label the lexicon alone
decides. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import durable
from strandmill.llm.decontamination import words_of

SAMPLE = 10_000
#: Documents of the sample that must show a feature.
SUPPORT = 3
#: Likelihood ratio a feature must show, and share of its documents labelled toxic for a mined voter.
GAIN, PRECISION = 15.0, 0.85
FOLDS = 5
#: Lengths of the word beginnings.
STEMS = (3, 4, 5, 6, 7, 8)
ROUNDS = 50
CACHE = 300_000

#: Insults that vote for toxic.
LEXICON = (
    "idiot", "idiots", "moron", "morons", "imbecile", "stupid", "dumb", "dumbass", "clown", "loser", "losers", "scum",
    "trash", "garbage", "worthless", "pathetic", "disgusting", "vermin", "filth", "pig", "rat", "freak", "creep",
    "bastard", "bitch", "asshole", "jerk", "retard", "coward", "liar", "fool", "parasite", "maggot", "hate", "kill", "die",
)
#: Pattern voters, on the lower-cased text.
PATTERNS = (
    ("shut_up", r"\bshut\s+up\b"),
    ("you_are", r"\byou(?:'re| are)\s+(?:a|an|so|such)\s+\w+"),
    ("go_die", r"\b(?:go|should)\s+(?:to\s+hell|die)\b"),
    ("shouting", r"!{3,}"),
    ("hate_you", r"\bi\s+(?:hate|despise)\s+(?:you|them)\b"),
)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(True))


def features_of(word: str) -> list[str]:
    return ["=" + word, *["^" + word[:n] for n in STEMS if len(word) > n]]


class _Known(dict):
    """Word -> numbers of its known features."""

    def __init__(self, number: dict[str, int]):
        self.number = number

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > CACHE:
            self.clear()
        found = tuple(self.number[f] for f in features_of(word.decode("utf-8", "replace")) if f in self.number)
        self[word] = found
        return found


def _all_features(batches):
    for batch in batches:
        rows = [sorted({f for w in set(words_of(t)) for f in features_of(w.decode("utf-8", "replace"))}) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.string()))], names=["toxic", "features"])


def _known_features(number: dict[str, int]):
    def run(batches):
        known, rules = _Known(number), [re.compile(p) for _, p in PATTERNS]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [sorted({f for w in set(words_of(t)) for f in known[w]}) for t in texts]
            votes = [[k for k, r in enumerate(rules) if t and r.search(t.lower())] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32())), pa.array(votes, pa.list_(pa.int32()))], names=["toxic", "features", "patterns"])

    return run


@dataclass
class Model:
    weights: dict[str, float]
    intercept: float


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _flat(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the entries of sparse 0/1 rows."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.repeat(np.arange(len(rows)), sizes), np.concatenate([np.asarray(r, np.int64) for r in rows]) if len(rows) else np.zeros(0, np.int64)


def parents(fired: list[np.ndarray], post: np.ndarray, voters: int) -> np.ndarray:
    """For each voter the one it depends on given the class, or -1.

    A parent fires more often (or as often, with a lower number), so there are no circles. It is the one whose co-firing
    tells most, as twice the gain in log likelihood over independence given the class, if that exceeds 2 log n.
    """
    n, out = len(fired), np.full(voters, -1)
    row, col = _flat(fired)
    mass = np.stack([1 - post, post])
    single = np.stack([np.bincount(col, m[row], voters) for m in mass])
    rank = np.empty(voters, np.int64)
    rank[np.lexsort((np.arange(voters), -single.sum(0)))] = np.arange(voters)
    both: dict[int, np.ndarray] = {}
    for i, each in enumerate(fired):
        each = np.asarray(each, np.int64)[np.argsort(rank[each])]
        up, down = np.triu_indices(len(each), 1)
        for code in (each[down] * voters + each[up]).tolist():
            if code not in both:
                both[code] = np.zeros(2)
            both[code] += mass[:, i]
    total, best = mass.sum(1), np.full(voters, 2 * np.log(max(n, 2)))
    for code in sorted(both):
        j, p = divmod(code, voters)
        gain = 0.0
        for y in (0, 1):
            a, b, t = single[y, j], single[y, p], total[y]
            table = ((both[code][y], a * b / t), (a - both[code][y], a * (t - b) / t), (b - both[code][y], (t - a) * b / t), (t - a - b + both[code][y], (t - a) * (t - b) / t))
            gain += 2 * sum(seen * np.log(seen / expected) for seen, expected in table if seen > 1e-9 and expected > 1e-9)
        if both[code].sum() * total.sum() > single[:, j].sum() * single[:, p].sum() and gain > best[j]:
            best[j], out[j] = gain, p
    return out


def label_model(fired: list[np.ndarray], labels: np.ndarray, voters: int) -> tuple[np.ndarray, dict]:
    """Posterior of label 1 for each row, given the voters that fire in it and its observed label, and the estimates behind it."""
    post = np.where(labels == 1, 0.95, 0.05)
    tree = parents(fired, post, voters)
    row, col = _flat(fired)
    sets = [set(np.asarray(f).tolist()) for f in fired]
    joined = np.fromiter((tree[c] >= 0 and int(tree[c]) in sets[r] for r, c in zip(row.tolist(), col.tolist())), bool, len(row))
    has = tree >= 0
    for step in range(ROUNDS):
        found = []
        for m in (1 - post, post):
            total = m.sum()
            alone, both = np.bincount(col, m[row], voters), np.bincount(col[joined], m[row[joined]], voters)
            of_parent = np.where(has, alone[tree], 0.0)
            # each voter's probability to fire beside a firing parent, and beside a silent one or without any
            beside, free = (both + 0.5) / (of_parent + 1), (alone - both + 0.5) / (total - of_parent + 1)
            quiet = np.log((1 - beside) / (1 - free))  # what a silent child adds where its parent fires
            log = np.log(total + 1) + np.log(1 - free).sum()  # all silent; then what each firing voter changes
            each = np.bincount(tree[has], quiet[has], voters)[col]
            each += np.where(joined, np.log(beside[col] / (1 - beside[col])), np.log(free[col] / (1 - free[col])))
            one = (m @ labels + 0.5) / (total + 1)
            found.append((log + np.bincount(row, each, len(labels)) + np.log(np.where(labels == 1, one, 1 - one)), one))
        new = _sigmoid(found[1][0] - found[0][0])
        moved, post = np.abs(new - post).max() if len(post) else 0.0, new
        if moved < 1e-4:
            break
    return post, {"parents": tree, "label": (found[1][1], 1 - found[0][1])}


def linear_fit(rows: list[np.ndarray], target: np.ndarray, features: int, ridge: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic regression of soft targets on sparse 0/1 rows, by Newton steps that conjugate gradients solve."""
    row, col = _flat(rows)
    pull = np.append(np.full(features, ridge), 1e-3)
    forth = lambda w: np.bincount(row, w[:-1][col], len(rows)) + w[-1]
    back = lambda r: np.append(np.bincount(col, r[row], features), r.sum())
    loss = lambda w, z: float((np.logaddexp(0, z) - target * z).sum() + (pull * w * w).sum() / 2)
    w = np.zeros(features + 1)
    z = forth(w)
    for _ in range(50):
        p = _sigmoid(z)
        grad, bend = back(p - target) + pull * w, p * (1 - p) + 1e-9
        step, left = np.zeros_like(w), -grad
        scale = 1 / (pull + np.append(np.bincount(col, bend[row], features), bend.sum()))  # the diagonal
        way = scale * left
        size = left @ way
        for _ in range(200):
            if size < 1e-16:
                break
            turned = back(bend * forth(way)) + pull * way
            much = size / (way @ turned)
            step, left = step + much * way, left - much * turned
            eased = scale * left
            size, old = left @ eased, size
            way = eased + size / old * way
        here, rate = loss(w, z), 1.0
        while rate > 1e-4 and loss(w + rate * step, forth(w + rate * step)) > here:
            rate /= 2
        w = w + rate * step
        z = forth(w)
        if np.abs(step).max() * rate < 1e-5:
            break
    return w[:-1], float(w[-1])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text) of the sample, at most SAMPLE rows; the ids are broadcast. A doc_id is one row, however often it occurs."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    one = usable.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other")
    picked = one.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on the sample. To the driver come, of the sample's at most SAMPLE rows, the features with evidence only."""
    sample = durable(training_rows(docs, labels))
    sizes = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n, bad = int(sizes[0]), int(sizes[1])
    if not bad or bad == n:
        return Model({"=" + w: 4.0 for w in LEXICON}, -2.0)
    shown = sample.mapInArrow(_all_features, "toxic int, features array<string>").select("toxic", F.explode("features").alias("f"))
    counts = shown.groupBy("f").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).where(F.col("n") >= SUPPORT)
    share, hit, miss = bad / n, F.col("bad"), F.col("n") - F.col("bad")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    gain = 2 * (part(hit, F.col("n") * share) + part(miss, F.col("n") * (1 - share)))
    best = sorted(counts.select("f", "n", "bad", gain.alias("gain")).where(F.col("gain") >= GAIN).collect(), key=lambda r: (-round(r["gain"], 9), r["f"]))
    fixed = ["=" + w for w in LEXICON]
    number = {f: k for k, f in enumerate(dict.fromkeys([*[r["f"] for r in best], *fixed]))}
    found = sample.mapInArrow(_known_features(number), "toxic int, features array<int>, patterns array<int>").toArrow().to_pylist()
    found.sort(key=lambda r: (r["toxic"], r["features"], r["patterns"]))
    mined = [number[r["f"]] for r in best if r["bad"] >= PRECISION * r["n"]]
    place = {f: k for k, f in enumerate(dict.fromkeys([*[number[f] for f in fixed], *mined]))}
    fired = [np.array([*[place[f] for f in r["features"] if f in place], *[len(place) + k for k in r["patterns"]]], np.int64) for r in found]
    post, _ = label_model(fired, np.array([r["toxic"] for r in found], np.float64), len(place) + len(PATTERNS))
    weights, intercept = linear_fit([np.array(r["features"], np.int64) for r in found], post, len(number))
    return Model({f: float(weights[k]) for f, k in number.items() if abs(weights[k]) > 1e-9}, intercept)


def _scorer(model: Model):
    def run(batches):
        names = list(model.weights)
        known, weight = _Known({f: k for k, f in enumerate(names)}), [model.weights[f] for f in names]
        for batch in batches:
            scores = []
            for text in batch.column(1).to_pylist():
                found = {f for w in set(words_of(text)) for f in known[w]}
                scores.append(float(_sigmoid(model.intercept + sum(weight[f] for f in sorted(found)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs`` (doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = own.mapInArrow(_scorer(model), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with a score below 0.5. The score joins the row in place, without a shuffle."""
    model = fit(docs, labels)
    table: dict = defaultdict(float, model.weights)

    def keep(batches):
        names = list(table)
        known, weight = _Known({f: k for k, f in enumerate(names)}), [table[f] for f in names]
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            good = [model.intercept + sum(weight[f] for f in sorted({f for w in set(words_of(t)) for f in known[w]})) < 0 for t in texts]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
