import binascii
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.llm import packing, queries, toxicity, url_filter, warc
from tests.llm.helpers import ODD, docs, prose


@pytest.fixture(scope="module")
def public_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


SPACES = ["a  b", " a", "a ", "a\n b", "a \nb", " x y", "tab\t x", "<|endoftext|> a", "it's  we'll\r\n", "　z", "a b"]


def test_packing_round_trip(spark, public_ids):
    rows = [*ODD, *enumerate(SPACES, 100), *[(200 + k, prose(k, 700 * (k % 5) + 3)) for k in range(30)]]
    got = packing.pack(docs(spark, rows)).collect()
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(public_ids(t))
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        if len(ids[r["doc_id"]]) == 1:
            part = ids[r["doc_id"]][0][r["start"] : r["start"] + r["length"]]
            assert r["doc_tokens"] == len(ids[r["doc_id"]][0])
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and len(part) == r["length"]
    for i, each in ids.items():
        assert sum(r["length"] for r in pieces[i]) == sum(map(len, each))
        if len(each) == 1:
            spans = sorted((r["start"], r["length"]) for r in pieces[i])
            assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
    padded = total = 0
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        total, padded = total + at, padded + (0 if at & (at - 1) == 0 else 2048 - at)
    assert padded < 0.01 * total


def test_harmonic_cuts():
    for n in [1, 31, 32, 33, 682, 1023, 1024, 1025, 2047, 2048, 2049, 9999]:
        cuts = packing.harmonic_cuts(n)
        assert sum(c for c, _ in cuts) == n and all(c * k <= 2048 for c, k in cuts)
        assert all(c == 2048 // k for c, k in cuts[:-1])


def test_packing_empty(spark):
    assert packing.pack(docs(spark, [])).count() == 0
    assert [r["length"] for r in packing.pack(docs(spark, [(1, "")])).collect()] == [1]


def crc(i):
    return binascii.crc32(str(i).encode())


def test_toxicity(spark):
    rows, labels = [*ODD], []
    for k in range(400):
        bad = k % 6 == 0
        words = prose(k, 60, 3000).split()
        if bad:
            words[7:7] = [["moron"], ["zaquip" + words[0]], ["blorf" + words[1], "blorf" + words[2]]][k % 3]
        rows.append((1000 + k, " ".join(words)))
        labels.append((1000 + k, None, int(bad)))
    lab = spark.createDataFrame([*labels, (None, 0, 1), (1, 0, None), (1001, 0, 1)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows)
    model = toxicity.fit(d, lab)
    got = {r["doc_id"]: r for r in toxicity.score(d, model).collect()}
    assert len(toxicity.score(d, model).collect()) == len(rows)
    held = [(got[i]["predicted"], t) for i, _, t in labels if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (crc(i) % 5 == 0) for i, _, _ in labels)
    assert len(held) > 40 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert sum(a for a, t in held if t) >= 0.85 * sum(t for _, t in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    kept = toxicity.drop_toxic(d, lab)
    assert kept.columns == d.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in toxicity.score(d, model).where("predicted = 0").collect())


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs(spark, [(1, "you moron"), (2, "good day"), (3, None)]), toxicity.fit(docs(spark, []), none)).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def plain_label_model(fired, labels, tree, rounds):
    """Expectation maximisation by loops, from the definition; tree: voter -> parent."""
    n, voters = len(labels), {v for f in fired for v in f} | set(tree)
    post = [0.95 if x == 1 else 0.05 for x in labels]
    for _ in range(rounds):
        log = [0.0] * n
        for y, sign in ((1, 1), (0, -1)):
            mass = [p if y else 1 - p for p in post]
            total = sum(mass)
            hold = lambda cond: sum(m for m, f in zip(mass, fired) if cond(f))  # noqa: B023, E731
            for i, f in enumerate(fired):
                log[i] += sign * np.log(total + 1)
                one = (sum(m for m, x in zip(mass, labels) if x == 1) + 0.5) / (total + 1)
                log[i] += sign * np.log(one if labels[i] == 1 else 1 - one)
            for v in voters:
                p = tree.get(v)
                with_ = (hold(lambda f: v in f and p in f) + 0.5) / (hold(lambda f: p in f) + 1)
                without = (hold(lambda f: v in f and p not in f) + 0.5) / (hold(lambda f: p not in f) + 1)
                fire = (hold(lambda f: v in f) + 0.5) / (total + 1)
                for i, f in enumerate(fired):
                    chance = fire if p is None else with_ if p in f else without
                    log[i] += sign * np.log(chance if v in f else 1 - chance)
        post = [1 / (1 + np.exp(-x)) for x in log]
    return post


def votes_of(seed, n):
    """Three voters that are one, one that is independent of them, one that is noise; labels that err."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.3
    one, two, noise = (y & (rng.random(n) < 0.8)) | (rng.random(n) < 0.04), (y & (rng.random(n) < 0.7)) | (rng.random(n) < 0.06), rng.random(n) < 0.2
    fired = [np.array([k for k, v in enumerate((a, a, a, b, c)) if v], np.int64) for a, b, c in zip(one, two, noise)]
    return y, fired, (y ^ (rng.random(n) < 0.04)).astype(float)


def test_label_model_equals_plain_loops(monkeypatch):
    _, fired, labels = votes_of(1, 150)
    monkeypatch.setattr(toxicity, "ROUNDS", 6)
    post, found = toxicity.label_model(fired, labels, 5)
    tree = {k: int(p) for k, p in enumerate(found["parents"]) if p >= 0}
    assert {1, 2} <= set(tree) and tree[1] == 0 and 4 not in tree
    assert np.allclose(post, plain_label_model([set(f.tolist()) for f in fired], labels.tolist(), tree, 6), atol=1e-4)


def test_label_model_mends_labels():
    """Voters and label together are right more often than the label, and copies of a voter add nothing."""
    y, fired, labels = votes_of(0, 4000)
    post, found = toxicity.label_model(fired, labels, 5)
    assert ((post > 0.5) == y).mean() > (labels == y).mean()
    single, _ = toxicity.label_model([f[(f != 1) & (f != 2)] for f in fired], labels, 5)
    assert np.abs(post - single).max() < 0.1


def test_linear_fit_is_the_minimum():
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(9) < 0.3) for _ in range(300)]
    target = rng.random(300)
    w, b = toxicity.linear_fit(rows, target, 9)
    x = np.zeros((300, 9))
    for i, r in enumerate(rows):
        x[i, r] = 1
    slope = 1 / (1 + np.exp(-(x @ w + b))) - target
    assert np.abs(x.T @ slope + 0.5 * w).max() < 1e-4 and abs(slope.sum() + 1e-3 * b) < 1e-4


def test_sample_is_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 5)
    d = docs(spark, [(k % 9, f"text {k}") for k in range(300)])
    lab = spark.createDataFrame([(k, 0, k % 2) for k in range(9)], "doc_id long, quality int, toxic int")
    assert toxicity.training_rows(d, lab).count() == 5


URLS = [
    (1, "http://a.com/x"), (2, "https://EXAMPLE.com/en/1?q"), (3, "http://www.example.com/en/2#f"), (4, "http://m.www.example.com/en/3"), (5, "ftp://b.net/es/9"), (6, "http://net/fr/"), (7, "http://b.net/en/9"),
    (8, "http://notexample.com/en/1"), (9, "http://a.com"), (10, "http://a.com?x=/y"), (11, None), (12, "no scheme"), (13, ""), (None, "http://c.org/p"), (14, "http://x.org://y.com/z"), (15, "http://b.net#/es/"), (1, "http://a.com/x"),
    (17, "http://ÉA.net/és/"), (18, "http://com/"), (19, "http://b.internet/es/1"),
]


def by_rules(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in URLS], "page_id long, url string, html string, host string")
    got = url_filter.judge_urls(pages).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r["page_id"], r["host"], r["path"], r["rule"]) for r in got], key=key) == sorted([(i, *by_rules(u)[:3]) for i, u in URLS], key=key)
    assert all(r["verdict"] == (by_rules(u)[3] or r["verdict"]) for r in got for i, u in URLS if i == r["page_id"])
    assert {r["verdict"] for r in got} == {"allow", "block"}


def test_url_templates(spark):
    rows = [("/en/12.html", "/en/{n}.html"), ("/a//b", "/a/b"), ("", "/"), ("/2024-01-02/x", "/{date}/x"), ("/deadbeef01/y", "/{hex}/y"), ("/abcdefghij1234k", "/{id}"), ("/" + "/".join("s" * 30), "/" + "/".join("s" * 30))]
    got = spark.createDataFrame(rows, "path string, want string").select("want", F.concat(F.lit("/"), F.array_join(url_filter.template(F.col("path")), "/")).alias("t")).collect()
    assert all(r["want"] == r["t"] for r in got)


def test_url_tree(spark):
    """A branch that the rules block is told from its siblings, and unlabelled pages beside it follow their template."""
    rows = [(k, f"http://h.net/es/{k}") for k in range(40)] + [(100 + k, f"http://h.net/en/{k}") for k in range(40)] + [(200 + k, f"http://h.net/de/x{k}") for k in range(3)]
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert {got[k]["verdict"] for k in range(40)} == {"block"} and {got[100 + k]["verdict"] for k in range(40)} == {"allow"}
    assert got[100]["template"] == "/en/{n}" and got[100]["purity"] == 0.5
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def plain_tree(urls):
    """{(host, segments): (template, purity)} by recursion, from the definition; urls: (host, segments, verdict)."""
    out, labels = {}, defaultdict(lambda: [0, 0])

    def walk(host, under, merged, level):
        bad, good = (sum(v == x for _, v in under) for x in ("block", "allow"))
        branches = defaultdict(list)
        for t, v in under:
            branches[t[level] if len(t) > level else ""].append((t, v))
        onward = defaultdict(list)
        for seg, rows in branches.items():
            b, g = (sum(v == x for _, v in rows) for x in ("block", "allow"))
            pooled = (bad + 1) / (bad + good + 2)
            z = abs((b + 1) / (b + g + 2) - pooled) / (pooled * (1 - pooled) * (1 / (b + g + 2) + 1 / (bad + good + 2))) ** 0.5
            rare = len(rows) < url_filter.SUPPORT or len(rows) < len(under) * url_filter.SHARE
            name = seg
            if seg and len(under) < url_filter.SUPPORT:
                name = "**"
            elif seg and len(rows) < len(under) and (rare or (b + g > 0 and z < url_filter.Z)):
                name = "*"
            if not seg or name == "**":
                for t, v in rows:
                    out[host, t] = (*merged, name) if seg else merged
                    labels[host, out[host, t]][v == "allow"] += v is not None
            else:
                onward[name] += rows
        for name, rows in onward.items():
            walk(host, rows, (*merged, name), level + 1)

    hosts = defaultdict(list)
    for h, t, v in urls:
        hosts[h].append((t, v))
    for h, rows in hosts.items():
        walk(h, rows, (), 0)
    return {k: (m, (labels[k[0], m][0] + 1) / (sum(labels[k[0], m]) + 2)) for k, m in out.items()}


def test_tree_equals_plain_recursion(spark):
    rng = np.random.default_rng(8)
    urls = []
    for _ in range(900):
        depth = int(rng.choice([0, 1, 2, 3, 4, 12], p=[0.05, 0.2, 0.25, 0.25, 0.2, 0.05]))
        segs = tuple(f"s{int(x)}" for x in np.minimum(rng.geometric(0.45, depth), 9))
        verdict = None if rng.random() < 0.5 else "block" if segs[:1] in (("s2",), ("s4",)) or segs[8:9] == ("s1",) else "allow"
        urls.append((f"h{int(rng.integers(0, 4))}", segs, verdict))
    urls += [("deep", tuple("x" * 11) + (f"y{k % 2}",), "block" if k % 2 else "allow") for k in range(40)] + [("few", ("a", "b", str(k)), None) for k in range(4)]
    df = spark.createDataFrame([(h, list(t), v) for h, t, v in urls], "host string, tpl array<string>, verdict string")
    got = {(r["host"], tuple(r["tpl"])): (tuple(r["merged"]), r["purity"]) for r in url_filter.template_tree(df).collect()}
    want = plain_tree(urls)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    assert {m[-1] for (h, _), (m, _) in want.items() if h == "deep"} == {"y0", "y1"} and ("*" in {x for m, _ in want.values() for x in m})
    assert {m for (h, _), (m, _) in want.items() if h == "few"} == {("**",)}


def pages_of(spark, n, extra=()):
    rows = [(k, f"http://h/{k}", f"<p>é{k}</p>" * (k % 7)) for k in range(n)] + list(extra)
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_audit_finds_what_differs(spark):
    good = warc.records(pages_of(spark, 1300, [(None, None, None), (5, None, "")]))
    one = warc.fixity(good).cache()
    assert warc.audit(one, warc.fixity(good)).count() == 0
    bad = good.withColumn("record", F.when(F.col("page_id").isin(3, 700, 1299), F.concat("record", F.lit(b"x"))).otherwise(F.col("record")))
    other = warc.fixity(bad).cache()
    got = warc.audit(one, other, moved=True).collect()
    assert {r["page_id"] for r in got if r["status"] == "changed"} == {3, 700, 1299} == {r["page_id"] for r in got if r["status"] != "moved"}
    places = lambda t: {(r["archive"], r["page_id"], r["sha256"]): r["offset"] for r in t.collect()}
    a, b = places(one), places(other)
    assert {(r["archive"], r["page_id"], r["hash_a"]) for r in got if r["status"] == "moved"} == {k for k in a if k in b and a[k] != b[k]} != set()
    fewer = warc.fixity(good.where("archive <> 2"))
    status = {(r["archive"], r["status"]) for r in warc.audit(one, fewer).collect()}
    assert status == {(2, "missing")}
    assert {(r["archive"], r["status"]) for r in warc.audit(fewer, one).collect()} == {(2, "extra")}


def test_a_lost_record_is_one_missing_record(spark):
    good = warc.records(pages_of(spark, 60))
    for lost in (0, 30, 59):
        got = warc.audit(warc.fixity(good), warc.fixity(good.where(f"page_id <> {lost}"))).collect()
        assert [(r["page_id"], r["status"]) for r in got] == [(lost, "missing")]
    got = warc.audit(warc.fixity(good.where("page_id <> 7")), warc.fixity(good)).collect()
    assert [(r["page_id"], r["status"]) for r in got] == [(7, "extra")]


def test_fixity_places(spark):
    """Offsets are those of the records end to end in their order; null and repeated ids and equal rows too."""
    rows = [(None, f"u{k % 9}", "x" * (k % 5)) for k in range(200)] + [(7, "u", f"body {k}") for k in range(90)] + [(8, "u", "same")] * 40 + [(600, None, None)]
    made = warc.records(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as archive", "2 as part", "3 as length"))
    got = warc.fixity(made).collect()
    data = [(r["archive"], r["page_id"], bytes(r["record"])) for r in made.collect()]
    import hashlib

    for archive in {-1, 0, 1}:
        distinct = sorted({(i is not None, i or 0, hashlib.sha256(d).hexdigest(), len(d)) for a, i, d in data if a == archive})
        copies = [sum(1 for a, i, d in data if a == archive and hashlib.sha256(d).hexdigest() == x[2]) for x in distinct]
        at = 0
        mine = sorted((r["ordinal"], r["offset"], r["length"], r["sha256"], r["copies"]) for r in got if r["archive"] == archive)
        for k, (x, n) in enumerate(zip(distinct, copies)):
            assert mine[k] == (k, at, x[3], x[2], n)
            at += x[3] * n
        assert len(mine) == len(distinct)
    fewer = warc.records(spark.createDataFrame(rows[:-5], "page_id long, url string, html string"))
    assert sorted((r["status"], r["page_id"], r["copies_a"], r["copies_b"]) for r in warc.audit(warc.fixity(made), warc.fixity(fewer)).collect()) == [("missing", 8, 40, 36), ("missing", 600, 1, None)]


def test_audit_report(spark, sf_dir):
    got = warc.audit_report(spark.read.parquet(f"{sf_dir}/pages.parquet")).toPandas()
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    want = con.execute(queries.ORACLE_SQL["op4_warc_audit"]).df()
    order = sorted(want.columns)
    assert got[order].sort_values(order).values.tolist() == want[order].sort_values(order).values.tolist()
    assert warc.audit_report(pages_of(spark, 0)).count() == 0


def test_read_warc(spark, tmp_path):
    import gzip

    made = warc.records(pages_of(spark, 20))
    for r in warc.archive_bytes(made).collect():
        (tmp_path / f"{r['archive']}.warc").write_bytes(bytes(r["content"]))
    back = warc.read_warc(spark, str(tmp_path)).orderBy("offset").collect()
    want = [(f"http://h/{k}", f"<p>é{k}</p>" * (k % 7)) for k in range(20)]
    assert [(r["uri"], bytes(r["body"]).decode()) for r in back] == want
    table = warc.fixity(made).orderBy("offset").collect()
    assert [(r["offset"], r["length"]) for r in back] == [(r["offset"], r["length"]) for r in table]
    plain = [bytes(r["record"]) for r in made.orderBy("page_id").collect()]
    packed = [gzip.compress(p) for p in plain]
    (tmp_path / "z.warc.gz").write_bytes(b"".join(packed))
    back = warc.read_warc(spark, str(tmp_path / "z.warc.gz")).orderBy("offset").collect()
    assert [(r["uri"], bytes(r["body"]).decode()) for r in back] == want and [r["length"] for r in back] == list(map(len, packed))
    odd = b"WARC/1.0\r\nno colon here\r\ncontent-length:3\r\nWARC-Target-URI:a:b\r\n\r\nabc\r\n\r\n"
    assert list(warc.parse_records("x", odd)) == [(0, len(odd), "a:b", b"abc")]
    with pytest.raises(ValueError, match="Content-Length"):
        list(warc.parse_records("x", b"WARC/1.0\r\nA: b\r\n\r\n"))
