"""The training-data operators against brute force, on small tables with nulls, empties, ties, repeats and clashing columns."""

import base64
import collections
import decimal
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from ravelin.llm import graph, hamming_topk, line_dedup, mixing, ngram_lm, pii, quality, sentencepiece_codec, simhash, suffix_dedup, toxicity
from ravelin.llm.queries import QUERIES, SQL, piece_model

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, _bad int, anchors int"


@pytest.fixture(scope="session")
def docs(spark):
    """Real documents and awkward ones; extra columns carry names that operators use inside."""
    real = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rng = random.Random(7)
    long = " ".join(rng.choice(real).replace("\n", " ")[:2000] for _ in range(60))
    odd = [None, "", " ", "\n\n", "a", "a b", "▁x  y ", "日本語😀 \x00é", "9" * 3000, "x" * 5000, "+1 (073) 555-8658 a@b.co.uk 10.0.0.256 1.2.3.4 4111 1111 1111 1111 a@b.com_c@d.e", real[3], real[3], real[4] + " tail", long, "w " * 400]
    rows = [(i, t, ["en", None][i % 2], [None, "s1", "s2"][i % 3], len(t or ""), "f", 0.5, 1, 2) for i, t in enumerate(real + odd)]
    rows += [(None, real[5], "en", "s1", 3, "f", 0.5, 1, 2), (2, real[2], "en", "s1", 3, "f", 0.5, 1, 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def held(docs):
    return sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def words(t):
    return WORD.findall(t)


def low(t):
    return t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def same(df, expected, *cols):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == sorted(expected, key=key)


def test_sentencepiece(docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    got = sentencepiece_codec.apply(docs, piece_model(), ("ids", "decoded", "n_tokens", "ids_sha256"))
    expected = []
    for d, t in held(docs):
        ids = lib.encode(t, add_eos=True)
        expected.append((d, tuple(ids), lib.decode(ids), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    same(got, [(d, list(i), x, n, h) for d, i, x, n, h in expected], "doc_id", "ids", "decoded", "n_tokens", "ids_sha256")


def test_sentencepiece_random():
    codec, rng = sentencepiece_codec.Codec.of(piece_model()), random.Random(3)
    texts = ["".join(rng.choice("ab é\n▁ 😀t<>#\tthe") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    encoded = codec.encode_batch(texts)
    ids = codec.lib.encode(texts, add_eos=True)
    assert encoded.spelled() == [" ".join(map(str, i)).encode() for i in ids]
    assert codec.decode_batch(encoded.ids(), encoded.id_bounds()) == codec.lib.decode(ids)


def test_sentencepiece_long_parts():
    codec, rng = sentencepiece_codec.Codec.of(piece_model()), random.Random(4)
    parts = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(0, 200))) for _ in range(200)] + ["a" * 5000, "=" * 3001, "ab" * 999]
    for part in parts:
        assert codec.merged_by_heap(part) == codec.merged_in_place(part)
    assert [codec.encode_text(p) for p in parts] == codec.lib.encode(parts, add_eos=True)


def test_top_k(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 64))
    v[50:120] = v[0]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [1.0]), (None, [1.0] * 64)]
    table = hamming_topk.codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = hamming_topk.search(table, table.where(F.col("id") % 100 == 0))
    code = {i: sum(1 << j for j in range(64) if r[j] > 0) for i, r in enumerate(np.float32(v))}
    expected = [(q, k + 1, i, d) for q in (0, 100, 200) for k, (d, i) in enumerate(sorted(((code[q] ^ c).bit_count(), i) for i, c in code.items() if i != q)[:10])]
    same(got, expected, "query_id", "rank", "id", "distance")
    assert hamming_topk.search(table.limit(0), table.limit(0)).count() == 0


def test_top_k_ties_outliers_and_few_rows(spark):
    """Many codes tied at the k-th distance, queries that nothing is near to, vectors with NaN, fewer rows than k."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(700, 64))
    v[0] = np.abs(v[0])
    for i in range(64):  # 64 codes at distance one from the first
        v[100 + i] = v[0]
        v[100 + i][i] = -1
    v[300:600] = -np.abs(v[300:600])
    v[200] = np.tile([1, -1], 32)
    v[650][:32] = np.nan
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    table = hamming_topk.codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    code = {i: sum(1 << j for j in range(64) if r[j] > 0) for i, r in enumerate(v)}
    for part, ids in ((table, range(700)), (table.where("id < 5"), range(5))):
        got = hamming_topk.search(part, part.where(F.col("id") % 100 == 0))
        same(got, [(q, k + 1, i, d) for q in ids if q % 100 == 0 for k, (d, i) in enumerate(sorted(((code[q] ^ code[i]).bit_count(), i) for i in ids if i != q)[:10])], "query_id", "rank", "id", "distance")


def test_top_k_gathers_nothing_that_grows_on_the_driver(spark):
    v = np.random.default_rng(7).normal(size=(600, 64))
    table = hamming_topk.codes(spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>"))
    runs = spark._jsparkSession.sharedState().statusStore()
    before = runs.executionsList().size()
    # only queries that scan are broadcast, a bounded number at a time, by another join
    assert hamming_topk.search(table, table.where("id % 20 = 0"), subcodes=8).count() == 300
    names = []
    for i in range(before, runs.executionsList().size()):
        nodes = runs.planGraph(runs.executionsList().apply(i).executionId()).allNodes()
        names += [nodes.apply(j).name() for j in range(nodes.size())]
    assert "SortMergeJoin" in names and not [x for x in names if x.startswith("BroadcastHashJoin")]


def test_pii(docs):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def passes(k, v):
        d = re.sub("[^0-9]", "", v)
        if k == "card":
            return 14 <= len(d) <= 19 and sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0
        return {"ip": lambda: all(int(x) <= 255 for x in v.split(".")), "phone": lambda: 10 <= len(d) <= 15}.get(k, lambda: True)()

    expected = []
    for d, t in held(docs):
        found = sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(patterns.items()) for m in re.finditer(p, t) if passes(k, m.group()))
        expected.append((d, *(sum(x[1] == i for x in found) for i in range(4)), hashlib.sha256(",".join(f"{list(patterns)[k]}:{s}:{e}" for s, k, e in found).encode()).hexdigest()))
    got = pii.digest(pii.detect(docs))
    same(got, expected, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert pii.digest(pii.detect(docs.limit(0))).count() == 0


def test_pii_method(spark):
    rows = [(i, f'some text token = "{hashlib.sha1(str(i).encode()).hexdigest()}" end') for i in range(40)] + [(100 + i, "call an incomprehensibilitiesword" + "x" * i) for i in range(40)]
    got = {r.doc_id: r.spans for r in pii.digest(pii.detect(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert all(got[i].startswith("secret:19:59") for i in range(40)) and not any(got[100 + i] for i in range(40))


def test_pii_candidates_by_hand(spark):
    """Places, clearance of base spans and contexts of candidates that stand close together, by regular expressions in Python."""
    rng = random.Random(5)
    bits = ["a@b.de ", "call 212-555-0199 ", "078-05-1120 ", "078-05-1120;", "Mr Xu ", "Dr Ab,", "é€ ", "write a (at) b (dot) com ", "token=ghp_0123456789abcdefghij ", "+1 212-555-0199 x ", "10.0.0.1 ", "a.b(at)c.de@f.gh ", "\n"]
    rows = [(i, "".join(rng.choices(bits, k=rng.choice([0, 1, 2, 5, 40, 130])))) for i in range(300)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    for r in found:
        t = texts[r.doc_id]
        want = []
        for k, p in pii.CANDIDATES.items():
            for m in regex.finditer(p, t):
                if all(b.e <= m.start() or m.end() <= b.s for b in r.base):
                    before = t[max(0, m.start() - pii.CONTEXT) : m.start()]
                    want.append((m.start(), pii.ORDER.index(k), m.end(), int(bool(regex.search(pii.CUES[k], before, regex.ASCII)))))
        assert [(x.s, x.k, x.e, x.context) for x in r.more] == want
        assert all(pii.BASE[b.k] != "email" or "@" in t[b.s : b.e] for b in r.base)


def test_pii_many_matches_in_one_text(spark):
    """60,000 addresses, each followed by a candidate, in one text."""
    n = 60_000
    t = "a@b.de 078-05-1120 " * n
    r = pii.find(spark.createDataFrame([(1, t)], "doc_id long, text string")).select(F.size("base").alias("n"), F.size("more").alias("m"), F.element_at("base", -1)["s"].alias("s"), F.element_at("more", -1)["s"].alias("c")).first()
    assert (r.n, r.m, r.s, r.c) == (n, n, 19 * (n - 1), 19 * (n - 1) + 7)


def test_pii_secrets_after_a_key(spark):
    sha = lambda i: hashlib.sha512(str(i).encode()).hexdigest()
    secrets = [lambda i: "ghp_" + sha(i)[:36], lambda i: "AKIA" + sha(i)[:16].upper(), lambda i: base64.b64encode(bytes.fromhex(sha(i)[:62])).decode(), lambda i: sha(i) + sha(-1 - i)]
    rows = [(i, f"some text token={secrets[i % 4](i)} end") for i in range(80)] + [(100 + i, "call=an incomprehensibilitiesword" + "x" * i) for i in range(40)]
    got = {r.doc_id: r.spans for r in pii.digest(pii.detect(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert all(f"secret:16:{16 + len(secrets[i % 4](i))}" in got[i] for i in range(80)) and not any(got[100 + i] for i in range(40))


def kept_bytes(rows, threshold=50):
    """(doc_id, n_bytes, n_removed, n_spans, digest) of every (doc_id, text), by looking at all strings."""
    seen: dict = {}
    out = []
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - threshold + 1):
            if d is not None:
                seen[b[i : i + threshold]] = min(d, seen.get(b[i : i + threshold], d))
    for d, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - threshold + 1):
            if d is not None and seen[b[i : i + threshold]] < d:
                gone[i : i + threshold] = b"\1" * threshold
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


BYTES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("group", [suffix_dedup.GROUP_BYTES, 20_000])
def test_suffix_dedup(docs, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 3 * group)
    same(suffix_dedup.dedup(docs), kept_bytes(held(docs)), *BYTES)
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0


def test_sweep(spark):
    from ravelin.llm import common

    df = common.stored(spark.range(3).withColumnRenamed("id", "x"), "kept")
    assert df.count() == 3 and common.sweep(spark) >= 1 and common.sweep(spark) == 0
    with pytest.raises(Exception, match="(?i)not.*exist|not found"):
        df.count()


def test_packed_numbers():
    from ravelin.llm.common import planes, unplaned

    for x in ([], [0], [5, 300, 2], [-1, 7, -(1 << 60)], [(1 << 63) - 1]):
        assert unplaned(planes(np.array(x, np.int64))).tolist() == x
    names = np.array([1, 7, (1 << 64) - 1], np.uint64)
    assert suffix_dedup.unpacked([suffix_dedup.packed(names), suffix_dedup.packed(names[:0])])[0].tolist() == names.tolist()


@pytest.mark.parametrize("threshold", [32, 50, 70])
def test_suffix_dedup_in_many_groups(spark, monkeypatch, threshold):
    """A passage that most texts share, near copies, repeated ids and copies, over many groups and ranges of names."""
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 3_000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 5_000)
    rng = random.Random(11)
    some = lambda n: "".join(rng.choice("abcde fg") for _ in range(n))
    passage, base = some(160), some(500)
    rows = [(i, some(rng.randint(0, 120)) + (passage[rng.randint(0, 60) :] if i % 3 else "") + some(rng.randint(0, 90))) for i in range(150)]
    rows += [(200 + i, base[: 9 * i] + "x" + base[9 * i + rng.randint(0, 2) :]) for i in range(50)]
    rows += [(rng.randint(150, 400), rows[i][1]) for i in range(0, 40, 3)] + [(300, some(80)), (300, base), (299, base), (300, rows[0][1]), (None, base), (500, "a" * 400), (501, "a" * 300), (-7, base + "q"), (-9, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(suffix_dedup.dedup(df, threshold), kept_bytes(rows, threshold), *BYTES)


def test_line_dedup(spark, docs):
    lines = ["This line stands everywhere.", "Only on seven sites, this one.", "tiny"]
    rows = [(i, f"own text number {i} goes here and is long enough to stay\n  {lines[0]} \n{lines[1] if i < 7 else 'x'}\n{lines[2]}", f"site{i}") for i in range(12)]
    rows += [(50 + i, lines[0], f"site{i}") for i in range(3)] + [(90, None, None)]
    got = {r.doc_id: r for r in line_dedup.apply(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].text == f"{rows[0][1].split(chr(10))[0]}\n{lines[1]}" and got[0].n_removed == 2  # lines of one word count as well
    assert got[11].text == f"{rows[11][1].split(chr(10))[0]}\nx"
    assert got[50].text == lines[0] and got[50].n_removed == 0 and got[50].n_boilerplate == 1
    assert got[90].text is None or got[90].text == ""
    assert line_dedup.apply(docs).count() == docs.count()


def test_line_keys_are_two_hashes(spark):
    """The second key is not made from the first: texts of one and the same first key would differ in the second."""
    import xxhash

    lines = ["a b c", "", "zeile", "x" * 300]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", *line_dedup.key(F.col("line"))).collect()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    seed = spark.range(1).select(F.xxhash64(F.lit(1))).first()[0] % (1 << 64)
    assert [(r.k1, r.k2) for r in rows] == [(signed(xxhash.xxh64_intdigest(x, 42)), signed(xxhash.xxh64_intdigest(x, seed))) for x in lines]


def test_line_dedup_at_the_threshold(spark):
    """Lines on seven, eight, nine and thirty sites, in one and in many documents of a site."""
    rows = [(1000 * n + i, f"line of {n} sites here\nown text {n} {i} that is long enough to stay as it is", f"site{i % n}") for n in (7, 8, 9, 11, 12, 30) for i in range(3 * n)]
    got = line_dedup.apply(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    assert all((r.n_removed == 1) == (r.doc_id >= 8000) for r in got) and len(got) == len(rows)
    assert line_dedup.apply(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_short_boilerplate_leaves_the_pipeline(spark):
    rows = [(i, f"own text number {i} goes here and is long enough to stay\nHome\n\n- And ornd.\n{'seven' if i < 7 else 'x'}", "en", f"site{i}", 9) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.drop_boilerplate(spark, df, SF).collect()}
    own = lambda i: rows[i][1].split("\n")[0]
    assert got[0].text == f"{own(0)}\n\nseven" and got[0].n_chars == len(got[0].text)
    assert got[11].text == f"{own(11)}\n\nx"


def test_mixing(spark):
    rows = [(i, "a" if i % 3 == 0 else f"s{i % 5}") for i in range(3000)] + [(None, None), (5, "s0"), (5, "s0")]
    weights = {"a": 0.5, "s0": 0.2, "s1": 0.1, "s2": 0.1, "s3": 0.05, "s4": 0.05}
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block=4, period=100).collect()
    assert len(got) == len(rows) and collections.Counter((r.doc_id, r.source) for r in got) == collections.Counter(rows)
    assert len({(r.mix_slot, r.mix_place) for r in got}) == len(rows)
    blocks = sorted({(r.mix_slot, r.source or "") for r in got})
    slots = collections.Counter(s for t, s in blocks if t < 100)
    taken, last = collections.Counter(), {s: max(t for t, x in blocks if x == s) for s in slots}
    share = {s: sum(t % 100 == p for p in {b % 100 for b, x in blocks if x == s} for t in range(100)) / 100 for s in slots}
    for t, s in blocks:
        for x in share:
            if t <= last[x]:
                assert abs(taken[x] - share[x] * t) < 1
        taken[s] += 1
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string")).count() == 0


def earliest_first(w, period, slots):
    """The source of each slot, by the definition: of the released blocks the one with the earliest deadline."""
    done, out = [0] * len(w), []
    for t in range(slots):
        due = [(-(-(d + 1) * period // x), i) for i, (d, x) in enumerate(zip(done, w)) if d * period < (t + 1) * x]
        i = min(due)[1]
        assert min(due)[0] > t
        done[i] += 1
        out.append(i)
    return out


@pytest.mark.parametrize(("weights", "target"), [({"a": 0.3337, "b": 0.6663}, None), ({"a": 0.5, "b": 0.25, "c": 0.125, "d": 0.125}, None), ({"a": 1, "b": 2, "c": 4}, None), (None, "root"), ({"a": 0.7, "b": 0.3, "x": 5}, "left out")])
def test_mixing_against_given_targets(spark, weights, target):
    """The whole schedule is earliest-deadline-first, and within one block of the weights asked for."""
    size = {"a": 9000, "b": 4000, "c": 2500, "d": 700} if target or len(weights) > 2 else {"a": 6000, "b": 12000}
    rows = [(i, s) for k, (s, n) in enumerate(size.items()) for i in range(100_000 * k, 100_000 * k + n)]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumns({c: F.lit(7) for c in ("mix_slot", "_row", "_source", "_turn", "n")})
    got = mixing.mix(df, weights, block=4).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in rows) and all(r._row == 7 for r in got)
    counts = spark.createDataFrame(list(size.items()), "source string, n long")
    w = {r.source: r.w for r in mixing.shares(counts, weights).collect()}
    assert sum(w.values()) == mixing.PERIOD
    if target != "left out":
        raw = {s: math.sqrt(n) if target else weights[s] for s, n in size.items() if target or s in weights}
        known = {s: x / sum(raw.values()) for s, x in raw.items()}
        assert all(abs(w[s] / mixing.PERIOD - x) < (1.5e-3 if len(known) < len(size) else 1.1e-6) for s, x in known.items())
    names = sorted(w)
    made = {(r.mix_slot, r.source) for r in got}
    assert len({t for t, _ in made}) == len(made) == sum(-(-n // 4) for n in size.values())
    plan = earliest_first([w[s] for s in names], mixing.PERIOD, max(t for t, _ in made) + 1)
    taken, last = collections.Counter(), {s: max(t for t, x in made if x == s) for s in size}
    at = dict(made)
    for t, i in enumerate(plan):
        assert t not in at or at[t] == names[i]
        assert t in at or t > last[names[i]]
        assert all(abs(taken[s] * mixing.PERIOD - w[s] * t) < mixing.PERIOD for s in size if t <= last[s])
        taken[names[i]] += 1
    of = collections.Counter((r.source, r.mix_block, r.mix_place) for r in got)
    assert set(of) == {(s, i // 4, i % 4) for s, n in size.items() for i in range(n)}


@pytest.mark.parametrize("weights", [None, {"a": 0.1234567, "b": 1 / 3, "c": 0.5432099666666667}])
def test_mixing_keeps_to_its_targets_for_millions_of_slots(spark, weights):
    """Within one block of the weights as asked for, roots of 3, 7 and 11 or parts of no short period, at each of 2,100,000 slots."""
    n = {"a": 3, "b": 7, "c": 11}
    raw = {s: decimal.Decimal(x).sqrt() if weights is None else decimal.Decimal(weights[s]) for s, x in n.items()}
    parts = mixing.shares(spark.createDataFrame(list(n.items()), "source string, n long"), weights)
    plan = mixing.schedule(parts, 2_100_000).toPandas().sort_values("slot")
    assert (plan.slot.to_numpy() == np.arange(2_100_000)).all()
    for s, x in raw.items():
        mine = (plan.source == s).to_numpy()
        share = np.longdouble(str(x / sum(raw.values())))
        assert (plan.turn.to_numpy()[mine] == np.arange(mine.sum())).all()
        assert np.abs(np.cumsum(mine) - share * np.arange(1, len(plan) + 1, dtype=np.longdouble)).max() < 1 + 1e-6


def test_mixing_of_many_sources(spark):
    """Three hundred sources: segments of more slots than usual, the same schedule as by the definition."""
    parts = mixing.shares(spark.createDataFrame([(f"s{i:03d}", 1 + i * i) for i in range(300)], "source string, n long"))
    w = {r.source: r.w for r in parts.collect()}
    names = sorted(w)
    got = [r.source for r in mixing.schedule(parts, 2400, length=600).orderBy("slot").collect()]
    assert got == [names[i] for i in earliest_first([w[s] for s in names], mixing.PERIOD, 2400)]


def test_quality(docs):
    expected = []
    for d, t in held(docs):
        w = words(t)
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        ls = [x for x in t.split("\n") if WORD.search(x)]
        expected.append((d, len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(ls) - len(set(ls)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    got = quality.judge(docs)
    same(got, expected, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got.where("base_failed and kept").count() == 0


def test_quality_by_common_words(spark):
    rng = random.Random(12)
    common = {"en": "the of and to in is that it".split(), "de": "der die und zu den das mit von".split()}
    own = [f"wort{i}" for i in range(900)]
    text = lambda lang, share=0.4: " ".join(rng.choice(common[lang] if rng.random() < share else own) for _ in range(120))
    rows = [(i, text(lang), lang) for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(500 + i, text(lang, 0), lang) for i, lang in enumerate(["en", "de"] * 3)] + [(600 + i, text("de"), "en") for i in range(3)] + [(700 + i, text("en"), "de") for i in range(3)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(r.base_failed for r in got.values()) and all(r.class_distance <= quality.MAX_CLASS_DISTANCE for r in got.values())
    assert all(got[i].kept == (i < 500) for i in got)


def test_quality_of_a_small_language(spark):
    """Junk alone in its language is not its own measure; a clean text alone in its language stays, and so does a lone document."""
    rng = random.Random(13)
    letters = "etaoinshrdlucmfw"
    text = lambda: " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(120)).capitalize() + "."
    rows = [(i, text(), "en") for i in range(60)] + [(100, " ".join(f"{i}{i * 7}" for i in range(200)), "xx"), (101, " ".join(f"#{i}|" for i in range(90)), None), (102, text(), "yy"), (103, text(), None)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i].kept for i in (100, 101, 102, 103)] == [False, False, True, True] and not got[100].base_failed
    assert got[102].word_distance is None and got[102].class_distance < quality.MAX_CLASS_DISTANCE
    lone = quality.judge(spark.createDataFrame(rows[60:61], "doc_id long, text string, lang string")).first()
    assert lone.kept and lone.class_distance is None and lone.word_distance is None


def quality_by_hand(rows):
    """{doc_id: (kept, class distance, word distance)} of (doc_id, text, lang)."""
    classes = [re.compile(f"[{c}]") for c in quality.CLASSES.values()]
    found = []
    for d, t, lang in rows:
        t, w = t or "", words(t or "")
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        c = [len(p.findall(t)) for p in classes]
        k = [sum(x.lower() == y for x in w) for y in quality.COMMON]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        found.append((d, lang or "", len(w), failed, [*c, len(t) - sum(c)], [*k, len(w) - sum(k)]))
    def total(lists):
        return [sum(x) for x in zip(*lists)] or None

    def distance(a, b):
        if not b or not sum(a) or not sum(b):
            return None
        p, q = ([x / sum(y) for x in y] for y in (a, b))
        part = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
        return math.sqrt(max(0.0, sum(part(x, (x + y) / 2) + part(y, (x + y) / 2) for x, y in zip(p, q)) / 2))

    out = {}
    good = [x for x in found if not x[3] and x[2] >= quality.GUARD_WORDS]
    for x in found:
        d, lang, n, failed, c, k = x
        others = [y for y in good if y is not x]
        own = [y for y in others if y[1] == lang]
        large = sum(sum(y[5]) for y in own) >= quality.MIN_REFERENCE
        dc = distance(c, total([y[4] for y in (own if large else others)]))
        dk = distance(k, total([y[5] for y in own])) if large else None
        near = (dc or 0) <= quality.MAX_CLASS_DISTANCE and (dk or 0) <= quality.MAX_WORD_DISTANCE
        out[d] = (not failed and (n < quality.GUARD_WORDS or near), dc, dk)
    return out


def test_quality_distances(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(90_000, None, None), (90_001, "", "en"), (90_002, "####  &&& 12 " * 30, "xx"), (90_003, "WORT der UND the " * 4 + " ".join(f"Ä{i}" for i in range(60)), None), (90_004, " ".join(f"{i}" for i in range(200)), "en"), (90_005, "The OF and " + "a" * 50_000, "en")]
    hand = quality_by_hand(rows)
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("w", F.lit(1))).collect()
    assert len(got) == len(rows) and not hand[90_004][0]
    same_number = lambda a, b: (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)
    assert all(r.kept == hand[r.doc_id][0] and same_number(r.class_distance, hand[r.doc_id][1]) and same_number(r.word_distance, hand[r.doc_id][2]) for r in got)
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_toxicity(spark):
    rng = random.Random(2)
    clean, bad = [f"wort{i}" for i in range(300)], ["idiot", "worthless", "trash"]
    rows = [(i, " ".join(rng.choices(clean, k=40) + (rng.choices(bad, k=3) if i % 4 == 0 else []))) for i in range(400)] + [(400, None), (401, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("p_toxic", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(200, None)], "doc_id long, toxic int")
    chain = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    assert all(got[i].is_toxic == (i % 4 == 0) for i in range(200, 400)) and not got[400].is_toxic and not got[401].is_toxic
    assert len(chain.weights) == 3 and [len(w) for w in chain.weights] == [len(chain.words) + 1 + c for c in range(3)]
    assert not any(r.is_toxic for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect())


def chain_by_hand(rows, places, seeds):
    """Weights of every category by full-batch descent over dense matrices, earlier ones as out-of-fold predictions."""

    def fit(x, y, use):
        x, y = x[use], y[use]
        n, rate = len(y), y.mean()
        weight = np.where(y > 0, 0.5 / max(rate, 1 / n), 0.5 / max(1 - rate, 1 / n)) * 0.5 + 0.5 if 0 < rate < 1 else np.ones(n)
        w, g2 = np.zeros(x.shape[1] + 1), np.full(x.shape[1] + 1, 1e-8)
        for _ in range(toxicity.STEPS):
            r = weight * (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y) / n
            g = np.append(x.T @ r + toxicity.RIDGE * w[:-1] / 2, r.sum())
            g2 += g * g
            w -= 0.5 * g / np.sqrt(g2)
        return w

    x = np.array([[w in words for w in places] for _, _, words in rows], float)
    out = []
    fold = np.arange(len(rows)) % toxicity.FOLDS
    for c in toxicity.CATEGORIES:
        y = np.array([float(label and (c == "toxic" or not seeds[c].isdisjoint(words))) for _, label, words in rows])
        out.append(fit(x, y, np.ones(len(y), bool)))
        unseen = np.zeros(len(y))
        for f in range(toxicity.FOLDS):
            w = fit(x, y, fold != f)
            unseen[fold == f] = (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))))[fold == f]
        x = np.column_stack([x, unseen])
    return out


def test_toxicity_is_the_chain_by_hand(spark):
    rng = random.Random(21)
    words = [f"wort{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, k=12) + (rng.choices(["idiot", "worthless", "schurke"], k=2) if i % 3 == 0 else []))) for i in range(150)]
    rows += [(900, rows[0][1]), (901, rows[1][1]), (902, ""), (903, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    label = {i: int(i % 3 == 0) for i in range(150)} | {900: 0, 901: 1, 902: 0, 903: 0}
    chain = toxicity.train(docs, spark.createDataFrame(list(label.items()), "doc_id long, toxic int"))
    by_text: dict = {}
    for i, t in rows:
        d, y = by_text.get(t, (i, 0))
        by_text[t] = (min(d, i), max(y, label[i]))
    mine = sorted((d, y, toxicity.presence(t)) for t, (d, y) in by_text.items())
    expected = chain_by_hand(mine, chain.words, {c: set(s) for c, s in toxicity.SEEDS.items()})
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(chain.weights, expected))
    again = toxicity.train(docs.repartition(7), spark.createDataFrame(list(label.items()), "doc_id long, toxic int"))
    assert again.words == chain.words and all(np.allclose(a, b) for a, b in zip(again.weights, chain.weights))
    p = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    x = np.array([[w in toxicity.presence(t) for w in chain.words] for _, t in rows], float)
    for c, w in zip(toxicity.CATEGORIES, chain.weights):
        z = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
        assert all(abs(p[i][f"p_{c}"] - v) < 1e-9 for (i, _), v in zip(rows, z) if i != 902)
        x = np.column_stack([x, z])
    assert toxicity.score(docs.limit(0), chain).count() == 0 and not p[902].is_toxic


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, bound in ((0, 10), (1, 1), (1000, 1 << 40), (5000, 6000), (300, 1 << 62)):
        v = np.sort(rng.integers(0, bound, n)).astype(np.uint64)
        ef = ngram_lm.EliasFano.encode(v, bound)
        assert (ef.access(np.arange(n)) == v).all()
        asked = np.concatenate([v, rng.integers(0, bound, 100).astype(np.uint64)])
        at = ef.find(asked)
        assert all((v[a] == x) if a >= 0 else x not in v for a, x in zip(at, asked))


def test_language_model(docs):
    rows = ngram_lm.folded(docs)
    got = ngram_lm.score(rows, ngram_lm.train(rows.where(~F.col("held_out")), min_word=2))
    tokens = [(d, [*low(t).encode().split(), None]) for d, t in held(docs)]
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    c = collections.Counter(w for d, t in tokens if not fold(d) for w in t)
    total = sum(c.values())
    expected = [(d, fold(d), len(t), sum(c[w] > 0 for w in t), total, round(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (len(c) + 1))) for w in t), 6)) for d, t in tokens]
    same(got.withColumn("b", F.round("base_score", 6)), expected, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "b")
    sums = got.groupBy("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).collect()
    assert all(r.s > r.b for r in sums if not r.held_out) and all(math.isfinite(r.s) for r in sums)
    none = ngram_lm.score(rows, ngram_lm.train(rows.limit(0)))
    assert none.where("n_known > 0").count() == 0 and none.count() == rows.count()


@pytest.mark.parametrize("shard, one_number", [(ngram_lm.SHARD, ngram_lm.ONE_NUMBER), (40, ngram_lm.ONE_NUMBER), (40, 1)])
def test_language_model_is_the_trigram_model(spark, monkeypatch, shard, one_number):
    """Scores against an interpolated model over plain counters; with small shards, contexts are cut; n-grams as one number and as two."""
    monkeypatch.setattr(ngram_lm, "SHARD", shard)
    monkeypatch.setattr(ngram_lm, "ONE_NUMBER", one_number)
    rng = random.Random(13)
    rows = [(i, " ".join(f"w{int(400 * rng.random() ** 4)}" for _ in range(rng.randint(0, 60)))) for i in range(120)] + [(500 + i, "w0 w1 W2") for i in range(200)] + [(900, None)]
    docs = ngram_lm.folded(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = {r.doc_id for r in docs.where(~F.col("held_out")).collect()}
    tokens = {d: [None, *low(t or "").split(), "."] for d, t in rows}
    uni, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    heads = collections.Counter()
    for d in kept:
        t = tokens[d]
        uni.update(t[1:])
        two.update(zip(t, t[1:]))
        three.update(zip(t, t[1:], t[2:]))
        heads.update(t[:-1])
    assert sum(c == 1 for c in three.values()) > 0.5 * len(three) and max(two.values()) > 150
    total, after, after2 = sum(uni.values()), collections.Counter(a for a, _ in two), collections.Counter(x[:2] for x in three)
    one = lambda w: (uni[w] + 0.1) / (total + 0.1 * (len(uni) + 1))
    pair = lambda a, w: max(two[a, w] - 0.75, 0) / heads[a] + 0.75 * after[a] / heads[a] * one(w) if heads[a] else one(w)
    prob = lambda a, b, w: max(three[a, b, w] - 0.75, 0) / two[a, b] + 0.75 * after2[a, b] / two[a, b] * pair(b, w) if after2[a, b] else pair(b, w)
    model, numbers = ngram_lm.trained(docs)
    assert shard > 100 or len(model.bigrams.edges) > 3 and len(model.trigrams.cuts) > 20
    assert model.triples.two == model.pairs.two == (one_number == 1)
    for r in ngram_lm.scored(numbers, model).collect():
        t = tokens[r.doc_id]
        expected = [math.log10(pair(*t[:2])), *(math.log10(prob(*x)) for x in zip(t, t[1:], t[2:]))]
        assert abs(r.score - sum(expected)) < 0.0005 * len(expected), (r, expected)
    none = docs.limit(0)
    assert ngram_lm.score(none, model).count() == 0


@pytest.mark.parametrize("one_number", [ngram_lm.ONE_NUMBER, 1])
def test_elias_fano_levels_give_back_all_probabilities(spark, monkeypatch, one_number):
    """Every n-gram is found at its own rank, with its discounted probability, its context's weight and first rank, over many shards."""
    monkeypatch.setattr(ngram_lm, "SHARD", 500)
    monkeypatch.setattr(ngram_lm, "ONE_NUMBER", one_number)
    rng = random.Random(14)
    rows = [(i, " ".join(f"w{int(300 * rng.random() ** 3)}" for _ in range(50))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False))
    model, numbers = ngram_lm.trained(docs)
    _, ids, ends = ngram_lm.joined([pa.RecordBatch.from_pylist([{"ids": r.ids} for r in numbers.collect()])], 0, model.wide)
    assert model.bigrams.most == max(collections.Counter(x[0] for x in {*zip(*(v.tolist() for v in model.pairs.parts(model.bigram_keys(ids, ends))))}).values())
    for level, keys in ((model.bigrams, model.bigram_keys(ids, ends)), (model.trigrams, model.trigram_keys(ids, ends))):
        distinct, c = np.unique(keys, return_counts=True)
        context, successor = level.keys.parts(distinct)
        assert (level.keys.unpacked(level.keys.packed(distinct)) == distinct).all() and successor.max() < level.keys.bound
        _, of, size = np.unique(context, return_inverse=True, return_counts=True)
        own, first = np.bincount(of, c), np.searchsorted(context, context)
        rank, probability, weight, begin = level.find(context, successor)
        assert (rank == np.arange(len(distinct))).all() and (begin == first).all() and len(level.cuts) > 5
        assert np.abs(probability / ((c - 0.75) / own[of]) - 1).max() < 0.0005 and np.abs(weight / (0.75 * size / own)[of] - 1).max() < 0.0005
        # a successor that no context has: the context's weight all the same, wherever its shards begin
        each = np.unique(context)
        rank, probability, weight, begin = level.find(each, np.full(len(each), level.keys.bound - 1))
        missing = rank < 0
        assert missing.any() and not probability[missing].any() and np.abs(weight / (0.75 * size / own) - 1).max() < 0.0005
        assert begin.tolist() == np.searchsorted(context, each).tolist()
    trigrams = len(np.unique(model.trigram_keys(ids, ends)))
    words = [t.split() + ["."] for _, t in rows]
    assert trigrams == len({x for t in words for x in zip(["^", *t], t, t[1:])})


def test_cuts_follow_the_rows_that_arrive(spark, monkeypatch):
    """An n-gram that every chunk sends counts as often in the cuts, so no shard takes many times the rows of the others."""
    monkeypatch.setattr(ngram_lm, "SHARD", 300)
    monkeypatch.setattr(ngram_lm, "CHUNK", 100)
    docs = spark.createDataFrame([(i, " ".join(f"a{j}" for j in range(40)) + f" b{i}") for i in range(200)], "doc_id long, text string").withColumn("held_out", F.lit(False))
    model, numbers = ngram_lm.trained(docs)
    sent = ngram_lm.counted(numbers, model.pairs, model.bigram_keys, model.bigrams.cuts, model.wide)
    rows = [sum(len(model.pairs.unpacked(r.k)) for r in v) for v in (lambda t: [[r for r in t if r.s == s] for s in {r.s for r in t}])(sent.collect())]
    assert len(rows) > 5 and max(rows) < 5 * sum(rows) / len(rows)


def sim(t, k=3):
    import xxhash

    w = words(low(t))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]), seed=42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def rooted(ids, linked):
    up = {d: d for d in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return find


def test_simhash(docs):
    named = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    fps = {d: sim(t) for d, t in held(named)}
    find = rooted(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
    got = simhash.groups(named).withColumn("h", F.lower(F.lpad(F.hex("fp"), 16, "0")))
    same(got, [(d, f"{f:016x}", find(d)) for d, f in fps.items()], "doc_id", "h", "component_id")
    assert simhash.groups(docs).count() == docs.count() and simhash.groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("chain", [1, 2])
def test_pigeonring_links_on_dense_groups(spark, chain):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    find = rooted(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3])
    got = simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fp long"), chain=chain).collect()
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 3 for r in got)
    mine = rooted(values, [(r.a % (1 << 64), r.b % (1 << 64)) for r in got])
    assert all(find(v) == mine(v) for v in values)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (2, 1), (3, 3), (7, 160)] + [(500, x) for x in range(501, 700)]
    find = rooted({x for e in edges for x in e}, edges)
    same(graph.components(spark.createDataFrame(edges, "a long, b long")), [(x, find(x)) for x in {y for a, b in edges if a != b for y in (a, b)}], "node", "root")


def test_near_duplicates(spark):
    rng = random.Random(6)
    base = [[f"w{rng.randrange(5000)}" for _ in range(300)] for _ in range(20)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(100 + i, " ".join(w[:290] + [f"z{j}" for j in range(10)])) for i, w in enumerate(base)]
    rows += [(200 + i, " ".join(w[::2])) for i, w in enumerate(base)] + [(300, ""), (301, None), (302, " ")]
    gone = {r.doc_id: r.root for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert gone == {100 + i: i for i in range(20)} | {301: 300, 302: 300}


def test_near_duplicates_in_a_family_below_the_limit(spark):
    """Texts of one family are alike but not near-duplicates; their twins must be found among them."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(300):
        w = list(base)
        for at in rng.sample(range(300), 7):
            w[at] = f"x{i}_{at}"
        twin = list(w)
        for at in rng.sample(range(300), 5):
            twin[at] = f"y{i}_{at}"
        rows += [(i, " ".join(w)), (1000 + i, " ".join(twin))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(296)} for d, t in rows}
    code = {r.doc_id: np.array(r.code, np.int64).view(np.uint64) for r in simhash.sketches(df).collect()}
    meets = lambda a, b: (((code[a] ^ code[b]).view(np.uint16)) == 0).any() and simhash.ring_mask(*((code[a] ^ code[b])[:2, None]))[0]
    alike = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    find = rooted(sets, [(a, b) for a, b in alike if meets(a, b)])
    assert sum(find(d) != d for d in sets) > 250 and len({find(d) for d in sets}) > 50
    same(simhash.near_duplicates(df), [(d, find(d)) for d in sets if find(d) != d], "doc_id", "root")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = db.execute(SQL[name])
    cols = [c[0] for c in found.description]
    assert sorted(map(tuple, QUERIES[name](spark, SF).select(*cols).collect())) == sorted(found.fetchall())


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    kept = {r.doc_id for r in out}
    assert len(kept) == len(out)
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seed = {d for d in toxic if {"idiot", "moron", "worthless", "trash"} & set(texts[d].lower().split())}
    assert not seed & kept and len(kept) > 0.7 * len(texts)
    left = collections.Counter(texts[d] for d in kept)
    assert max(left.values()) == 1


def test_pipeline_by_hand(spark, tmp_path):
    """Toxic documents go, boilerplate lines go, one document of each group stays, all others are tokenised: on a table with nulls, empty and long texts, copies, and columns that clash."""
    rng = random.Random(31)
    some = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    bad = ["idiot", "worthless", "trash", "schurke"]
    rows = [(i, some(60) + ("\nclick here now" if i < 40 else ""), "en", f"site{i % 10}") for i in range(120)]
    rows += [(200 + i, some(40) + " " + " ".join(rng.choices(bad, k=4)), "en", "s") for i in range(60)]
    long = [f"v{i}" for i in range(3000)]
    rows += [(300, " ".join(long), "de", None), (301, " ".join(long[:-30] + ["z"] * 30), "de", "s"), (302, rows[50][1], None, "s"), (303, None, "en", "s"), (304, "", "en", "s"), (305, " \n", "en", None), (306, "▁ a  b", "en", "s")]
    df = spark.createDataFrame([(*r, len(r[1] or ""), 7, 0.5, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, mix_slot int, p_toxic double, fp string")
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0, 0) for i in range(100)] + [(200 + i, 0, 1) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    text = {d: (t or "").replace("\nclick here now", "") for d, t, *_ in rows}
    assert set(out) == {*range(120), 300, 303, 306}
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    for d, r in out.items():
        ids = lib.encode(text[d], add_eos=True)
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert len({(r.mix_slot, r.mix_place) for r in out.values()}) == len(out)


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_keeps_the_order_of_the_mix(spark, tmp_path):
    rng = random.Random(8)
    source = {i: f"s{min(i % 6, 2)}" for i in range(1500)}
    rows = [(i, " ".join(f"w{rng.randrange(9000)}" for _ in range(30)), "en", s, 0) for i, s in source.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", *corpus_pipeline.PLACE).collect()
    at = {(r.mix_slot, r.mix_place): source[r.doc_id] for r in out}
    assert len(out) == len(at) == len(rows)
    counts = spark.createDataFrame(list(collections.Counter(source.values()).items()), "source string, n long")
    share = {r.source: r.w / mixing.PERIOD for r in mixing.shares(counts, None, mixing.PERIOD).collect()}
    blocks = {slot: s for (slot, _), s in at.items()}
    assert all(blocks[slot] == s for (slot, _), s in at.items()) and len(blocks) > 90
    last, taken = {s: max(t for t, x in blocks.items() if x == s) for s in share}, collections.Counter()
    for t in range(min(last.values()) + 1):
        assert all(abs(taken[s] - share[s] * t) < 1 for s in share)
        taken[blocks[t]] += 1
