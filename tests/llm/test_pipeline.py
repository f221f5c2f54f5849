import corpus_pipeline
from strandmill.llm import decontamination, exact_dedup, near_dedup, toxicity


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near dedup", "decontamination", "packing"]
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    want = ids(docs)
    want -= ids(toxicity.score(docs, toxicity.fit(docs, labels)).where("predicted = 1"))
    now = docs.where(docs.doc_id.isin(*want))
    want = ids(exact_dedup.exact_groups(now).where("kept"))
    now = docs.where(docs.doc_id.isin(*want))
    want = {r["component_id"] for r in near_dedup.near_groups(now).collect()}
    now = docs.where(docs.doc_id.isin(*want))
    want -= ids(decontamination.contamination(now, bench))
    out = corpus_pipeline.run(spark, sf_dir).cache()
    assert ids(out) == want and 0 < len(want) < docs.count()
    here = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        here = stage(spark, here, sf_dir)
        assert here.columns == docs.columns


def plain_pipeline(rows, items):
    """The stages by plain loops, from their definitions; without labels the lexicon decides. Returns {doc_id: text} of what is packed."""
    import re

    import xxhash

    from strandmill.llm.toxicity import LEXICON

    def lower(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")

    def words(t):
        return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower())

    kept = [(i, t) for i, t in rows if not set(words(t)) & set(LEXICON)]
    last: dict = {}
    for i, t in kept:
        last[lower(t)] = max(i, last.get(lower(t), i))
    kept = [(i, t) for i, t in kept if last[lower(t)] == i]

    def fingerprint(t):
        own = [w for w in lower(t).translate({c: " " for c in range(9, 14)}).split(" ") if w]
        if not own:
            return 0
        hashes = [xxhash.xxh64(" ".join(own[k : k + 4]).encode(), seed=42).intdigest() for k in range(max(1, len(own) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: fingerprint(t) for i, t in kept}
    group = {i: i for i in prints}
    for _ in prints:
        moved = {i: min(group[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4) for i in prints}
        if moved == group:
            break
        group = moved
    kept = [(i, t) for i, t in kept if group[i] == i]

    def holds(text, item):
        a, b = words(item), words(text)
        row = [0] * (len(b) + 1)
        for n, x in enumerate(a, 1):
            new = [n]
            for m, y in enumerate(b, 1):
                new.append(min(row[m] + 1, new[-1] + 1, row[m - 1] + (x != y)))
            row = new
        return min(row) <= int(len(a) * 0.2 + 1e-9)

    return {i: t for i, t in kept if not any(words(x) and holds(t, x) for x in items)}


def test_run_equals_plain_loops(spark, tmp_path):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from tests.llm.helpers import prose

    rows = [(k, prose(k, 20 + k % 50, 900)) for k in range(60)]
    items = [prose(700 + k, 25, 900) for k in range(4)]
    rows += [(100 + k, prose(k, 20 + k % 50, 900).upper()) for k in range(0, 60, 7)]  # exact copies
    rows += [(200 + k, prose(k, 20 + k % 50, 900).replace(" ", "\n ")) for k in range(0, 60, 9)]  # the same words
    rows += [(1000 + k, prose(k, 2500, 900) + (" end" if k % 2 else "")) for k in (90, 91)] + [(1010 + k, prose(k, 2500, 900)) for k in (90, 91)]
    for k in range(8):  # passages of items, some of them edited
        body = items[k % 4].split()
        body[5 + k : 5 + k + k % 3] = ["new"] * (k % 3)
        rows.append((400 + k, prose(800 + k, 30, 900) + " " + " ".join(body) + " " + prose(850 + k, 9, 900)))
    rows += [(500 + k, prose(900 + k, 30, 900) + f" you {w}!") for k, w in enumerate(("moron", "IDIOT", "scum"))] + [(600, None), (601, ""), (602, " \t"), (603, "a <|endoftext|> b")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = plain_pipeline(rows, items)
    got: dict = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    assert set(got) == set(want) and 40 < len(want) < len(rows) - 20
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in want.items():
        ids = [*tokens.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for start, length, crc in sorted(got[i]):
            assert start == at and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
