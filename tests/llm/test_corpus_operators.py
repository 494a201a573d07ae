"""Operators across documents: PII, decontamination, near-duplicates, importance, fingerprints, the pipeline."""

import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, decontaminate, editembed, grouping, importance, minhash, pii, queries

TESTDATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, root string, band long, sketch string, n int"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{TESTDATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, columns whose names the operators use."""
    long = " ".join(f"word{i % 977}" for i in range(20_000))
    body = "one two three four five six seven eight nine ten"
    rows = [(1, body), (1, body), (2, body), (3, ""), (4, ""), (5, None), (None, None), (None, body), (6, long), (7, long + " end"), (8, "... !!!"), (9, "... !!!"), (10, "lonely words here now")]
    return spark.createDataFrame([(d, t, "en", "s", len(t) if t else None, "k", "r", 1, "s", 1) for d, t in rows], DOCS)


# --- PII


def test_permutation_is_one():
    for size in (1, 2, 3, 10, 26, 257):
        assert sorted(pii.permute(i, size, b"k", "x") for i in range(size)) == list(range(size))


def test_surrogates_keep_type_format_and_checks():
    k = pii.DEMO_KEY
    text, n = pii.replace("Mr. John Smith (John.Smith@mail.example.com) paid 4111 1111 1111 1111, 4111111111111111; Mrs Smith +1 (017) 555-7713, 10.1.2.3.", k)
    assert n == 8 and "Smith" not in text and "4111 1111" not in text
    surname = re.search(r"Mrs (\w+)", text).group(1)
    given = re.search(r"Mr\. (\w+) (\w+)", text)
    assert given.group(2) == surname and given.group(1) in pii._GIVEN["latin", "m"]
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", text)
    assert cards[0].replace(" ", "") == cards[1] and pii._luhn(cards[1][:-1]) == int(cards[1][-1])
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", text) and re.search(r"\b10\.\d+\.\d+\.\d+\.$", text)
    assert pii._mod97(pii.surrogate("iban", "DE89370400440532013000", k)) == 1
    for name, group in (("Анна", ("cyrillic", "f")), ("Γιάννης", ("greek", "m")), ("Mary", ("latin", "f"))):
        new = pii.surrogate("given:x", name, k)
        assert new != name and new in pii._GIVEN[group]
    assert pii.surrogate("secret", "deadbeef00", k) != pii.surrogate("secret", "deadbeef00", b"other")


def test_surrogates_are_distinct():
    k = pii.DEMO_KEY
    phones = [f"1{i:010d}" for i in range(3000)]
    assert len({pii.surrogate("phone", p, k) for p in phones}) == 3000
    mails = [f"user{i}@mail{i % 7}.example.com" for i in range(3000)]
    assert len({pii.surrogate("email", m, k) for m in mails}) == 3000
    assert len({pii.surrogate("ip", f"9.8.{i // 200}.{i % 200}", k) for i in range(2000)}) == 2000
    names = pii._GIVEN["latin", "m"]
    assert len({pii.surrogate("given:m", x, k) for x in names}) == len(set(names))


#: Patterns of their own, as plain as can be, for what the tables hold.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])",
    "phone": r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}",
    "card": r"(?<![\d-])(?:\d{4} ){3}\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
}


def _plain(kind, raw):
    return raw.lower() if kind == "email" else raw if kind == "ip" else re.sub(r"\D", "", raw)


def test_pii_against_brute_force(spark):
    """Texts are aligned by what lies between entities that plain patterns find; each entity has one surrogate of its shape, no two share one, none is a real value."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r.text for r in documents.collect()}
    new = {r.doc_id: r for r in pii.replaced(documents).collect()}
    assert set(new) == set(rows)
    seen: dict[tuple[str, str], set[str]] = {}
    untouched = aligned = 0
    for i, text in rows.items():
        if not new[i].n_replaced:
            assert new[i].text == text
            untouched += 1
        for kind, pattern in PLAIN.items():
            old, now = ([m.group() for m in re.finditer(pattern, t)] for t in (text, new[i].text))
            assert len(old) == len(now), (i, kind, old, now)
            aligned += len(old)
            for a, b in zip(old, now):
                seen.setdefault((kind, _plain(kind, a)), set()).add(_plain(kind, b))
                assert kind == "ip" or [c.isdigit() for c in a if not c.isalpha()] == [c.isdigit() for c in b if not c.isalpha()] or kind == "email"
    assert untouched > 0.8 * len(rows) and aligned > 20 and all(len(v) == 1 for v in seen.values())
    assert len({(k[0], *v) for k, v in seen.items()}) == len(seen)
    assert not {(k, *v) for (k, _), v in seen.items()} & set(seen)


def test_pii_names_keep_person_script_and_gender():
    k = pii.DEMO_KEY
    name = lambda t: re.search(r"[^\W\d_]+ [^\W\d_]+$", pii.replace(t, k)[0]).group()
    assert name("Mr Tariq Khan") == name("My name is Tariq Khan") == name("Dr Tariq Khan") != "Tariq Khan"
    man, woman = name("Господин Пётр Иванов"), name("Госпожа Анна Иванова")
    assert man.split()[1] + "а" == woman.split()[1] and man.endswith("ов") and "Иван" not in man
    assert pii.replace("Κυρία Ελένη Παπαδοπούλου", k)[0].endswith("ου")
    letters = "βγσρτλμ"
    greek = {f"{a.upper()}{v}{b}" for a in letters for v in "αειου" for b in [*letters[:2], "ς", "σ"]}
    assert len({pii.surrogate("surname", g, k) for g in greek}) == len(greek)
    slavic = {f"{a.upper()}{v}{b}{e}" for a in "бвгд" for v in "аеи" for b in "ктн" for e in ("ов", "ова", "ин", "а", "ь", "")}
    assert len({pii.surrogate("surname", x, k) for x in slavic}) == len(slavic)
    assert all(pii.ending(pii.surrogate("surname", x, k)) == pii.ending(x) for x in slavic)


def test_pii_short_formats_grow_and_full_ones_fail(spark, monkeypatch):
    """All two-letter surnames of a format are real: their surrogates get longer. All of a format's numbers are real: an error."""
    k = pii.DEMO_KEY
    names = [a.upper() + b for a in pii._LATIN[0] for b in "aeiou"]
    docs = spark.createDataFrame([(0, ". ".join(f"Mr {n}" for n in names))], "doc_id long, text string")
    text = pii.replaced(docs, k).first().text
    new = re.findall(r"Mr (\w+)", text)
    assert len(set(new)) == len(names) and not set(new) & set(names)
    monkeypatch.setattr(pii, "VAIN", 2)
    full = spark.createDataFrame([(0, " ".join(f"192.168.{a}.{b}" for a in range(256) for b in range(256)))], "doc_id long, text string")
    with pytest.raises(ValueError, match="no free ip"):
        pii.replaced(full, k)


def test_pii_many_entities_in_one_text():
    import time

    text = " ".join(f"user{i}@mail.example.com" for i in range(20_000))
    began = time.time()
    assert len(pii.find(text)) == 20_000 and time.time() - began < 5


def test_pii_collisions_are_resolved(spark):
    """In a full domain of five-digit parts some surrogates are real values; those entities get others."""
    k = pii.DEMO_KEY
    real = ["1" + pii.surrogate("phone", "10170000001", k)[1:], "10170000001", "10170000002"]
    docs = spark.createDataFrame([(i, f"+1 ({r[1:4]}) {r[4:7]}-{r[7:]}") for i, r in enumerate(real)], "doc_id long, text string")
    odd = pii.collisions(docs, k).collect()
    assert [r.value for r in odd] == ["10170000001"]
    new = {pii.canonical("phone", r.text) for r in pii.replaced(docs, k).collect()}
    assert len(new) == 3 and not new & set(real)


def test_pii_many_exceptions(spark, monkeypatch):
    k = pii.DEMO_KEY
    real = [pii.surrogate("phone", "10170000001", k), "10170000001"]
    docs = spark.createDataFrame([(i, f"+1 ({r[1:4]}) {r[4:7]}-{r[7:]}", "x") for i, r in enumerate(real)] + [(None, None, None)], "doc_id long, text string, key string")
    want = sorted(map(str, pii.replaced(docs, k).collect()))
    monkeypatch.setattr(pii, "SMALL_EXCEPTIONS", -1)
    assert sorted(map(str, pii.replaced(docs, k).collect())) == want


def test_pii_odd_rows(spark, odd):
    rows = pii.replaced(odd).collect()
    assert len(rows) == 13 and all(r.n_replaced == 0 for r in rows)
    wide = odd.select("doc_id", "text", *[F.lit(i).alias(n) for i, n in enumerate(["__text", "__n", "new_text", "Replaced", "odd", "key", "a.b"])])
    assert {tuple(r)[2:] for r in pii.anonymised(wide).collect()} == {tuple(range(7))} and pii.anonymised(wide).columns == wide.columns
    assert pii.anonymised(odd).columns == odd.columns and sorted(map(str, pii.anonymised(odd).collect())) == sorted(map(str, odd.collect()))
    assert pii.replaced(odd.limit(0)).count() == 0


# --- Decontamination


def test_fm_index_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n, sigma = int(rng.integers(1, 200)), int(rng.integers(2, 7))
        text = rng.integers(0, sigma, n).astype(np.int64)
        text[-1] = 0
        index = decontaminate.FMIndex(text, sigma, sample=int(rng.integers(1, 9)))
        for length in (1, 2, 4):
            phrases = rng.integers(1, sigma, (12, length)).astype(np.int64)
            for p, a, b in zip(phrases, *index.ranges(phrases)):
                assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n - length + 1) if (text[i : i + length] == p).all()]


def test_wavelet_tree_ranks():
    rng = np.random.default_rng(0)
    s = rng.integers(0, 11, 500)
    tree = decontaminate.WaveletTree(s, 11)
    base = tree.rank(np.arange(11), np.zeros(11, np.int64))
    for c in range(11):
        at = rng.integers(0, 501, 20)
        assert (tree.rank(np.full(20, c), at) - base[c] == [(s[:i] == c).sum() for i in at]).all()


def _brute_spans(text, items, n=8):
    words = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
    hit = []
    for item in items:
        w = [x.lower() for x in re.findall(r"[^\W_]+", item)]
        k = min(n, len(w))
        phrases = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k >= decontaminate.MIN_WORDS else set()
        hit += [(words[i][1], words[i + k - 1][2], []) for i in range(len(words) - k + 1) if tuple(x for x, *_ in words[i : i + k]) in phrases]
    return [(a, b) for a, b, _ in decontaminate.merge(hit)]


def test_decontamination_against_brute_force(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    items = [r.text for r in bench.collect()]
    want = {r.doc_id: s for r in docs.collect() if (s := _brute_spans(r.text, items))}
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == want and len(want) > 5
    assert decontaminate.contaminated(decontaminate.decontaminated(docs, bench), bench).count() == 0


def test_decontamination_in_parts_is_the_same(spark, documents):
    bench = spark.read.parquet(f"{TESTDATA}/benchmark.parquet")
    spans = lambda **k: sorted(map(str, decontaminate.with_spans(documents, bench, **k)[0].select("doc_id", "spans").collect()))
    whole = spans()
    assert spans(part_bytes=2000) == whole and spans(shard_chars=5000) == whole


def test_index_holds_every_word_of_a_shard(documents):
    texts = [r.text for r in documents.collect()]
    parts = [common.Tokens(run) for _, run in common.chunks(texts)]
    text, token, known = decontaminate.shard_text(parts)
    words = sum(len(re.findall(r"[^\W_]+", t)) for t in texts)
    assert (text > 0).sum() == words == (token >= 0).sum() and (text == 0).sum() == sum(bool(re.search(r"[^\W_]", t)) for t in texts)
    assert (known[text[text > 0] - 1] == np.concatenate([t.hash for t in parts])).all() and text[-1] == 0


def test_decontamination_of_short_items_and_any_column_names(spark):
    docs = spark.createDataFrame([(1, "Yes, a single word", 1, 2), (2, "no such", 1, 2), (3, "two words here; two, WORDS.", 1, 2)], "doc_id long, text string, spans int, Cut int").withColumn("a.b", F.lit(7))
    bench = spark.createDataFrame([(1, "yes"), (2, "two words"), (3, "?!"), (4, "no such item anywhere")], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.decontaminated(docs, bench).collect()}
    assert [out[i].text for i in (1, 2, 3)] == [", a single word", "no such", " here; ."] and all(tuple(r)[2:] == (1, 2, 7) for r in out.values())


def test_decontamination_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "ONE two, three four five six seven eight nine"), (1, "ONE two, three four five six seven eight nine"), (2, None), (None, "lonely words here now"), (3, ""), (4, "a b"), (5, "lonely, words here NOW")], "item_id long, text string")
    rows = decontaminate.contaminated(odd, bench).collect()
    assert sorted((r.doc_id or -1, r.text, tuple(r["items"])) for r in rows) == [(-1, " ten", (1,)), (1, " ten", (1,)), (1, " ten", (1,)), (2, " ten", (1,)), (10, "", (5,))]
    out = decontaminate.decontaminated(odd, bench)
    assert out.columns == odd.columns and out.count() == 12 and out.where("doc_id = 2").first().n_chars == 4
    assert out.where("doc_id = 10").count() == 0 and out.where("text IS NULL").count() == 2
    assert decontaminate.contaminated(odd.limit(0), bench).count() == 0 and decontaminate.contaminated(odd, bench.limit(0)).count() == 0


# --- Near-duplicates


def _jaccard_pairs(rows, least):
    sets = {i: frozenset(minhash.shingle_sets([t])[1].tolist()) for i, t in rows}
    ids = [i for i, _ in rows]
    return [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]


def test_super_minhash_is_unbiased_with_less_variance():
    rng, size, runs = np.random.default_rng(0), 64, 300
    found = []
    for _ in range(runs):
        a = rng.integers(0, 2**63, 30).astype(np.uint64)
        b = np.concatenate((a[:20], rng.integers(0, 2**63, 10).astype(np.uint64)))
        s = minhash.super_minhash(np.repeat([0, 1], 30), np.concatenate((a, b)), 2, size)
        found.append((s[0] == s[1]).mean())
    assert abs(np.mean(found) - 0.5) < 0.02 and np.var(found) < 0.75 * 0.25 / size


def test_super_minhash_step_by_step():
    """Each component's value is the least over elements of step + fraction, permutations drawn one element at a time."""
    rng, size = np.random.default_rng(2), 16
    for n in (1, 3, 50):
        elements = rng.integers(0, 2**63, n).astype(np.uint64)
        want = np.full(size, np.inf)
        for e in elements:
            perm = list(range(size))
            for j in range(size):
                draw = int(common.mix(np.array([e], np.uint64) + np.uint64(minhash._STEP * (2 * j + 1) % 2**64))[0])
                k = j + int(common.mix(np.array([e], np.uint64) + np.uint64(minhash._STEP * (2 * j + 2) % 2**64))[0]) % (size - j)
                perm[j], perm[k] = perm[k], perm[j]
                want[perm[j]] = min(want[perm[j]], j + (draw >> 11) * 2.0**-53)
        assert (minhash.super_minhash(np.zeros(n, np.int64), elements, 1, size)[0] == want).all()


def test_near_duplicates_against_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    pairs = _jaccard_pairs(rows, minhash.THRESHOLD)
    group = {r.doc_id: r.group_id for r in minhash.near_duplicates(documents).collect()}
    assert pairs and sum(group.get(a, -1) == group.get(b, -2) for a, b in pairs) / len(pairs) >= 0.9
    sets = grouping.UnionFind()
    for a, b in pairs:
        sets.union(a, b)
    assert all(sets.find(i) == g for i, g in group.items())


def test_near_duplicates_siblings(spark):
    """Copies that differ more from one another than from their original are found through second-round pairs too."""
    random.seed(4)
    base = [f"w{random.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(80):
        words = [f"x{random.randrange(10**6)}" if random.random() < 0.09 else w for w in base]
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"z{random.randrange(10**6)}" for _ in range(300))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = _jaccard_pairs(rows, minhash.THRESHOLD)
    group = {r.doc_id: r.group_id for r in minhash.near_duplicates(docs).collect()}
    assert sum(group.get(a, -1) == group.get(b, -2) for a, b in pairs) / len(pairs) >= 0.9
    assert not any(i >= 1000 for i in group)


def test_near_duplicates_odd_rows(spark, odd):
    rows = {(r.doc_id, r.group_id, r.keep) for r in minhash.near_duplicates(odd).collect()}
    assert rows == {(1, 1, True), (2, 1, False), (None, 1, False), (3, 3, True), (4, 3, False), (6, 6, True), (7, 6, False), (8, 8, True), (9, 8, False)}
    out = minhash.without_near_duplicates(odd)
    assert out.columns == odd.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["1", "3", "5", "None", "6", "8", "10"])
    names = ["id", "key", "text_key", "N", "keep", "__text", "__id", "__key", "__n", "__kept", "a.b", "a`b"]
    wide = odd.select("doc_id", "text", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    kept = minhash.without_near_duplicates(wide)
    assert kept.columns == wide.columns and {tuple(r)[2:] for r in kept.collect()} == {tuple(range(len(names)))} and kept.count() == 7
    assert minhash.near_duplicates(odd.limit(0)).count() == 0 and minhash.without_near_duplicates(odd.limit(0)).count() == 0


def test_components_both_ways(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(7, 7), (None, 3), (1, 2), (2, 1)] + [(i, i + 1) for i in range(1000, 1060)]
    df = spark.createDataFrame(edges, "a long, b long")
    sets = grouping.UnionFind()
    for a, b in edges:
        if a is not None and a != b:
            sets.union(a, b)
    want = sorted((x, sets.find(x)) for x in sets.parent)
    assert sorted(map(tuple, grouping.components(df).collect())) == want
    assert sorted(map(tuple, grouping.components(df, local_edges=0).collect())) == want
    assert grouping.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [grouping.BLOCK, 4])
def test_pairs_refused_at_first_do_not_hide_others(spark, block):
    """Key 99 is alike only to the key of its bucket whose sketch promises least; 20 lookalikes in the same component come first. Blocks change nothing."""
    sketch = lambda i: np.array([7, *(1 if k < (8 if i == 99 else i % 8) else 100 * i + k for k in range(9))], np.uint16)
    rows = [(i, sketch(i).tobytes()) for i in [*range(21), 99]]
    sketches = common.stored(spark.createDataFrame(rows, "key long, sketch binary"))
    content = lambda keys: keys.selectExpr("key", "CAST(char(key) AS BINARY) AS content")
    alike = lambda a, b: float(99 not in (a[0], b[0]) or {a[0], b[0]} == {99, 8})
    edges = grouping.verified_edges(sketches, content, np.uint16, 10, minhash.estimate, 0.1, alike, lambda score: score >= 1, block=block)
    assert {(r.a, r.b) for r in edges.collect() if 99 in (r.a, r.b)} == {(8, 99)}
    assert {r.root for r in grouping.components(edges.select("a", "b")).collect()} == {0}


def test_low_thresholds_find_their_pairs(spark):
    """Bands and floor follow the threshold: 60 pairs just above 0.3 are all found, and none below."""
    random.seed(9)
    rows = []
    for i in range(120):
        a = [f"p{i}w{k}" for k in range(200)]
        cut = 101 if i < 60 else 85
        b = a[:cut] + [f"q{i}w{k}" for k in range(200 - cut)]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    pairs = set(_jaccard_pairs(rows, 0.3))
    assert len(pairs) == 60
    group = {r.doc_id: r.group_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 0.3).collect()}
    assert sum(group.get(a, -1) == group.get(b, -2) for a, b in pairs) >= 59 and len(group) <= 120
    assert minhash.band_rows(0.5) == 4 and minhash.band_rows(0.3) < 4 and minhash.estimate_floor(0.3) < 0.3


def test_hot_bucket_of_unlike_texts(spark):
    """A bucket of 3,000 unlike members is thinned within runs and compared in pairs of blocks of some 200; the one pair in it that is alike is found."""
    rng = np.random.default_rng(4)
    sketch = rng.integers(0, 2**16, (3000, 20)).astype(np.uint16)
    sketch[:, 0] = 7
    sketch[2999, :15] = sketch[1234, :15]
    rows = [(i, s.tobytes()) for i, s in enumerate(sketch)]
    sketches = common.stored(spark.createDataFrame(rows, "key long, sketch binary").repartition(4))
    content = lambda keys: keys.selectExpr("key", "CAST(CAST(key AS STRING) AS BINARY) AS content")
    alike = lambda a, b: float({int(a), int(b)} == {1234, 2999})
    edges = grouping.verified_edges(sketches, content, np.uint16, 20, minhash.estimate, 0.5, alike, lambda score: score >= 1, block=200).collect()
    assert [(r.a, r.b) for r in edges] == [(1234, 2999)]


def test_contents_that_come_twice_and_pivots_with_many_pairs(spark, monkeypatch):
    """Repeats of a content give no second edge, and the pairs of one pivot are verified in several shares, all of them."""
    monkeypatch.setattr(grouping, "SHARE", 3)
    pairs = common.stored(spark.createDataFrame([(0, i) for i in range(1, 40)] + [(1, 2), (5, 7)], "a long, b long"))
    content = lambda keys: keys.unionByName(keys).selectExpr("key", "CAST(CAST(key AS STRING) AS BINARY) AS content")
    rows = grouping._verified(pairs, content, lambda a, b: float(int(b) - int(a))).collect()
    assert sorted(map(tuple, rows)) == sorted((a, b, float(b - a)) for a, b in map(tuple, pairs.collect()))


def test_shuffle_files_go_with_their_tables(spark):
    """Nothing of what was shuffled for a table is on disk once the table is discarded, or while the next part of it is written."""
    files = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()
    common.sweep(spark)
    time.sleep(1)
    before = files()
    common.discard(common.stored(*[spark.range(100_000).repartition(8, "id") for _ in range(2)]))
    left = []
    while len(left) < 50 and (not left or left[-1] > before):
        time.sleep(0.1)
        left.append(files())
    assert left[-1] <= before


def test_anchor_weights_count_all_texts(spark, documents):
    """Against a plain count; a run of characters that every text has weighs less, and copies are told by what is left."""
    texts = [f"common opening {i} " + " ".join(f"w{i * 37 % 1009 + k}" for k in range(60)) for i in range(300)]
    df = spark.createDataFrame([(t,) for t in [*texts, ""]], "text string")
    total = np.zeros(editembed.COUNTERS)
    for t in texts:
        gram = editembed.segments([t], np.array([10**9]), np.array([True]))[3]
        np.add.at(total, editembed._counter(gram), 1)
    share = total / 301
    weights = editembed.anchor_weights(df)
    assert np.allclose(weights, np.maximum(1, (share - share.mean()) / editembed.SHARE)) and weights.max() > 20
    assert (editembed.anchor_weights(df.limit(0)) == 1).all()


# --- Importance


def test_importance_weights_against_brute_force(spark, documents):
    labels = spark.read.parquet(f"{TESTDATA}/labels.parquet")
    ratio = importance.fit(documents, labels)
    good = {r.doc_id for r in importance.clean_labels(labels).where("good").collect()}
    raw, target = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS)
    for r in documents.collect():
        _, b = importance.features([r.text])
        np.add.at(raw, b, 1)
        if r.doc_id in good:
            np.add.at(target, b, 1)
    p, q = target + 1, raw + 1
    assert np.allclose(ratio, np.log(p / p.sum()) - np.log(q / q.sum()))
    rows = importance.resample(documents, labels, share=0.5).collect()
    assert len(rows) == round(0.5 * documents.count())
    for r in rows[:10]:
        text = documents.where(f"doc_id = {r.doc_id}").first().text
        assert math.isclose(r.log_weight, ratio[importance.features([text])[1]].sum(), abs_tol=1e-6)


def test_importance_tells_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    chosen = {r.doc_id for r in importance.resample(docs, labels.where("doc_id % 2 = 0")).collect()}
    rows = labels.where("doc_id % 2 = 1").collect()
    kept = lambda q: np.mean([r.doc_id in chosen for r in rows if r.quality == q])
    assert kept(1) > 0.9 and kept(0) < 0.5


def test_gumbel_top_k_is_weighted_sampling(spark):
    df = spark.range(40_000).selectExpr("id AS i", "xxhash64(id) AS h").withColumn("g", importance.gumbel("h"))
    mean = df.selectExpr("avg(g)").first()[0]
    assert abs(mean - 0.5772) < 0.02


@pytest.mark.parametrize("k", [0, 1, 37, 500, 999, 1000, 2000])
def test_top_k_against_sorting(spark, monkeypatch, k):
    monkeypatch.setattr(importance, "SORTED_ROWS", 20)
    monkeypatch.setattr(importance, "CELLS", 7)
    random.seed(k)
    rows = [(i, random.choice([random.gauss(0, 1), 0.25, -1.0])) for i in range(1000)]
    df = common.stored(spark.createDataFrame(rows, "i long, x double"))
    assert sorted(map(tuple, importance.top_k(df, k, "x", "i").collect())) == sorted(sorted(rows, key=lambda r: (-r[1], r[0]))[:k])


def test_importance_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, None), (3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = importance.resample(odd, labels, share=1.0).collect()
    assert len(rows) == 9 and not {r.doc_id for r in rows} & {3, 4, 5}
    assert importance.resample(odd, labels.limit(0)).count() == 9 and importance.resample(odd.limit(0), labels).count() == 0


# --- Fingerprints


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    random.seed(1)
    for _ in range(600):
        a = "".join(random.choice("abé") for _ in range(random.randrange(40)))
        b = _with_character_edits(a, 0.1) if random.random() < 0.6 and a else "".join(random.choice("abé") for _ in range(random.randrange(40)))
        d = _levenshtein(a, b)
        assert editembed.edit_distance(a, b) == d <= editembed.distance_bound(a, b)
        for most in (0, 1, 3, 7, 20):
            assert editembed.edit_distance(a, b, most) == (d if d <= most else None)
    words = [f"w{random.randrange(500)}" for _ in range(400)]
    a, b = " ".join(words), " ".join(w if random.random() > 0.05 else "zz" for w in words)
    assert editembed.edit_distance(a, b) == _levenshtein(a, b) <= editembed.distance_bound(a, b) <= 2 * _levenshtein(a, b)


def test_walks_step_by_step():
    text = "Some words that a walk goes over, again and again."
    cp = np.array([ord(c) for c in text] + [0] * editembed.STEPS, np.uint32)
    begin = np.array([0, 5, 40])
    for some in (range(editembed.STEPS), (3, 17, 30)):
        shown = editembed.walk(cp, begin, some)
        for place, out in zip(begin, shown.T):
            at, want = place, []
            for t in range(editembed.STEPS):
                want.append(cp[at])
                at += int(editembed._BITS[t][cp[at] & 63])
            assert out.tolist() == [want[t] for t in some]


def test_fingerprints_walk_every_segment(monkeypatch):
    """A plain version walks from each anchor by itself; cutting texts into pieces changes nothing; each character is walked over."""
    random.seed(5)
    texts = ["".join(random.choice("abcde fé😀") for _ in range(n)) for n in (0, 1, 5, 8, 9, 300, 5000)]
    want = np.zeros((len(texts), editembed.WALKS + 1), np.uint32)
    want[:, editembed.WALKS] = list(map(len, texts))
    for i, text in enumerate(texts):
        cp = np.array([ord(c) for c in text], np.uint32)
        codes, passed = [], set()
        for at in range(len(text)):
            gram = editembed._grams(np.concatenate((cp[at : at + editembed.GRAM], np.zeros(editembed.GRAM, np.uint32)))[: editembed.GRAM], editembed.GRAM)[0]
            if at and (at + editembed.GRAM > len(text) or gram >= 2**64 // editembed.DENSITY):
                continue
            place, shown = at, []
            for t in range(editembed.STEPS):
                c = int(cp[place]) if place < len(text) else 0
                passed.add(place)
                shown.append(c)
                place = min(place + int(editembed._BITS[t][c & 63]), len(text))
            codes.append([int(common.mix(np.array([gram]) * editembed._STEP + np.array([shown[t]], np.uint64))[0]) for t in editembed._COORDINATES])
        for k in range(editembed.WALKS if codes else 0):
            least = min(float(c[k % editembed.SAMPLES] * int(editembed._ORDERS[k]) % 2**64 >> 1) for c in codes)
            want[i, k] = int(common.mix(np.array([least]).view(np.uint64))[0]) >> 32
        assert len(passed & set(range(len(text)))) >= 0.85 * len(text)
    assert (editembed.fingerprints(texts) == want).all()
    monkeypatch.setattr(editembed, "PIECE", 100)
    assert (editembed.fingerprints(texts) == want).all()


def test_walks_map_edits_to_few_differences():
    random.seed(2)
    words = [f"word{random.randrange(3000)}" for _ in range(400)]
    near = [w if random.random() > 0.05 else "other" for w in words]
    far = [f"word{random.randrange(3000)}" for _ in range(400)]
    p = editembed.fingerprints([" ".join(words), " ".join(near), " ".join(far)])
    same = lambda x, y: float(editembed.estimate(p[x : x + 1], p[y : y + 1])[0])
    assert same(0, 1) > 0.6 and same(0, 2) < 0.25


def test_fingerprints_against_brute_force(spark, documents):
    """Whole texts of whatever length; the distances of all pairs come from a full matrix where a text is short, else from the banded one with the widest band."""
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    pairs = []
    for k, (a, s) in enumerate(rows):
        for b, t in rows[:k]:
            longer = max(len(s), len(t))
            if abs(len(s) - len(t)) <= 0.1 * longer and editembed.least_distance(s, t) <= 0.1 * longer:
                d = _levenshtein(s, t) if longer < 400 else editembed.edit_distance(s, t)
                pairs += [(a, b)] if d <= 0.1 * longer + 1e-9 else []
    group = {r.doc_id: r.group_id for r in editembed.fingerprint_groups(documents).collect()}
    assert pairs and sum(group.get(a, -1) == group.get(b, -2) for a, b in pairs) / len(pairs) >= 0.95
    sets = grouping.UnionFind()
    for a, b in pairs:
        sets.union(a, b)
    assert all(sets.find(i) == g for i, g in group.items())


def test_fingerprints_odd_rows(spark, odd):
    rows = {(r.doc_id, r.group_id) for r in editembed.fingerprint_groups(odd).collect()}
    assert rows == {(1, 1), (2, 1), (None, 1), (3, 3), (4, 3), (6, 6), (7, 6), (8, 8), (9, 8)}
    assert editembed.fingerprint_groups(odd.limit(0)).count() == 0

def _with_character_edits(text, rate):
    signs, out = sorted(set(text)), []
    for c in text:
        kind = random.randrange(3) if random.random() < rate else 3
        out.append((random.choice(signs), c + random.choice(signs), "", c)[kind])
    return "".join(out)


def test_fingerprints_find_edits_of_characters(spark):
    """Edits of single characters, down to the threshold: of 60 documents of sf0.1, at least 90 % of copies are found at each rate."""
    random.seed(6)
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    weights = editembed.anchor_weights(documents.select("text"))
    texts = [r.text for r in documents.where("length(text) BETWEEN 400 AND 4000").orderBy("doc_id").limit(60).collect()]
    for rate in (0.03, 0.05, 0.07, 0.09):
        copies = [_with_character_edits(t, rate) for t in texts]
        alike = [i for i, (a, b) in enumerate(zip(texts, copies)) if 1 - editembed.edit_distance(a, b) / max(len(a), len(b)) >= editembed.THRESHOLD]
        a, b = editembed.fingerprints(texts, weights), editembed.fingerprints(copies, weights)
        shared = (grouping.bands(a, editembed.BANDS) == grouping.bands(b, editembed.BANDS)).any(axis=1) & (editembed.estimate(a, b) >= editembed.estimate_floor(editembed.THRESHOLD))
        assert len(alike) > 40 and shared[alike].mean() >= 0.9
        assert all(editembed.similarity(editembed.pack(texts[i]), editembed.pack(copies[i])) >= editembed.THRESHOLD for i in alike)


def test_walks_of_very_long_texts_stay_at_their_anchors():
    """A word inserted early into a text of more than 2**20 words moves no walk to another place."""
    words = [f"{i * 2654435761 % 2**32:x}" for i in range(2_500_000)]
    copy = [*words[:40_000], "other", *words[40_000:]]
    assert editembed.estimate(editembed.fingerprints([" ".join(words)]), editembed.fingerprints([" ".join(copy)]))[0] > 0.95


def test_short_texts_are_compared_without_bands(monkeypatch):
    """Distances of short texts are those of bands, at any bound, and make none; both are right about texts at the limit too."""
    random.seed(14)
    pairs = [("", ""), ("", "é"), ("a" * editembed.SHORT, "a" * editembed.SHORT + "b"), ("\ud800x", "x\ud800")]
    for _ in range(150):
        a = "".join(random.choice("abé\U0001f600") for _ in range(random.choice((3, 30, 64, 65, editembed.SHORT))))
        b = _with_character_edits(a, 0.1) if random.random() < 0.6 else "".join(random.choice("abé\U0001f600") for _ in range(random.randrange(editembed.SHORT + 1)))
        pairs.append((a, b))
    want = [_levenshtein(a, b) for a, b in pairs]
    for limit in (editembed.SHORT, 0):
        monkeypatch.setattr(editembed, "SHORT", limit)
        for (a, b), d in zip(pairs, want):
            assert editembed.edit_distance(a, b) == d
            for most in (0, 1, 5, d, 60):
                assert editembed.edit_distance(a, b, most) == (d if d <= most else None)
    monkeypatch.undo()
    monkeypatch.setattr(editembed, "_banded", None)
    assert [editembed.edit_distance(a, b) for a, b in pairs if max(len(a), len(b)) <= editembed.SHORT] == [d for (a, b), d in zip(pairs, want) if max(len(a), len(b)) <= editembed.SHORT]


def test_runs_place_texts_by_what_each_has_once(monkeypatch):
    """Runs of characters that a text repeats place nothing; between those that place it, both texts are equal. Hashes don't depend on how many are made at once."""
    codes = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32)
    random.seed(15)
    for _ in range(60):
        words = [f"w{random.randrange(60)}" for _ in range(random.randrange(4, 200))]
        a, b = " ".join(words), " ".join(w if random.random() > 0.1 else "zz" for w in words)
        gaps, at = editembed._gaps(codes(a), codes(b)), (0, 0)
        for i, j, k, m in gaps:
            assert a[at[0] : i] == b[at[1] : k] and i <= j and k <= m
            at = j, m
        assert at == (len(a), len(b))
    repeated = "one and the same line. " * 5
    assert editembed._gaps(codes(repeated), codes("x" + repeated)) == [(0, len(repeated), 0, len(repeated) + 1)]
    text = codes("".join(random.choice("abcdefgh") for _ in range(1000)))
    want = [editembed._grams(text, w) for w in (1, 5, 8, 12)]
    for cached in (1, 7, 999, 1000):
        monkeypatch.setattr(editembed, "CACHED", cached)
        assert all((editembed._grams(text, w) == h).all() for w, h in zip((1, 5, 8, 12), want))


@pytest.mark.parametrize("width", [1, 3, None])
def test_groups_share_their_estimates(width):
    """Each key's best pairs across components, for 300 groups at once and with few calls; ties go to the first row."""
    rng = np.random.default_rng(16)
    size = rng.integers(1, 12, 300)
    group = np.repeat(np.arange(300), size)
    n = len(group)
    root, block = rng.integers(0, 4, n), np.where(group % 2 == 0, -1, rng.integers(0, 2, n))
    sketch = rng.integers(0, 3, (n, 6)).astype(np.uint8)
    calls = []

    def estimate(a, b):
        calls.append(len(a))
        return (a == b).mean(axis=1)

    pairs, cut = grouping._joining(sketch, root, estimate, 0.3, width, block, group)
    assert len(calls) <= 2 and len(set(map(tuple, pairs.tolist()))) == len(pairs)
    want, more = set(), set()
    for g in range(300):
        rows = np.flatnonzero(group == g).tolist()
        roots = root[rows].tolist()
        largest = min(set(roots), key=lambda r: (-roots.count(r), r))
        for i in rows:
            if root[i] == largest:
                continue
            others = [j for j in rows if root[j] != root[i] and (block[i] < 0 or block[i] != block[j]) and (sketch[i] == sketch[j]).mean() >= 0.3]
            others.sort(key=lambda j: (-(sketch[i] == sketch[j]).mean(), j))
            want |= {(i, j) for j in others[:width]}
            if width is not None and len(others) > width:
                more.add(g)
    assert set(map(tuple, pairs.tolist())) == want and cut.tolist() == sorted(more) and len(want) > 100


def test_buckets_go_on_in_the_next_batch(spark):
    """Two buckets with a key each that is alike only to its bucket's least promising one: the ends of batches change nothing."""
    sketch = lambda i: np.array([7 + i // 100, *(1 if k < (8 if i % 100 == 99 else i % 8) else 100 * i + k for k in range(9))], np.uint16)
    sketches = common.stored(spark.createDataFrame([(i, sketch(i).tobytes()) for i in [*range(21), 99, *range(100, 121), 199]], "key long, sketch binary"))
    content = lambda keys: keys.selectExpr("key", "CAST(CAST(key AS STRING) AS BINARY) AS content")
    alike = lambda a, b: float(int(a) // 100 == int(b) // 100 and (99 not in (int(a) % 100, int(b) % 100) or {int(a) % 100, int(b) % 100} == {99, 8}))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        edges = {(r.a, r.b) for r in grouping.verified_edges(sketches, content, np.uint16, 10, minhash.estimate, 0.1, alike, lambda score: score >= 1).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {e for e in edges if e[1] % 100 == 99} == {(8, 99), (108, 199)}


def test_least_distance_is_at_most_the_distance():
    random.seed(8)
    for _ in range(300):
        a = "".join(random.choice("abé ") for _ in range(random.randrange(60)))
        b = _with_character_edits(a, 0.2) if random.random() < 0.7 else "".join(random.choice("abé ") for _ in range(random.randrange(60)))
        assert editembed.least_distance(a, b) <= _levenshtein(a, b)


def test_blocks_refuse_no_pair_within_the_threshold():
    """At rates of edits about the threshold, words moved too: what blocks refuse is beyond it, and clear cases are refused before any whole distance is computed."""
    random.seed(12)
    pairs, refusable = [], 0
    for i in range(120):
        words = [f"w{random.randrange(2000)}" for _ in range(random.randrange(5, 300))]
        a = " ".join(words)
        if i % 3 == 0:
            cut = len(words) // 10
            words = words[cut:] + words[:cut]
        rate = random.choice((0.0, 0.02, 0.08, 0.1, 0.12, 0.3))
        b = _with_character_edits(" ".join(words), rate)
        pairs.append((a, b, int(0.1 * max(len(a), len(b)))))
    codes = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32)
    refused = editembed._refused([(codes(a), codes(b), most) for a, b, most in pairs])
    for (a, b, most), no in zip(pairs, refused):
        d = editembed.edit_distance(a, b)
        assert d > most or not no
        refusable += no
        bound = editembed.distance_bound(a, b, most)
        assert (bound if bound <= most else d) >= d
    assert refusable > 30
    got = editembed.similarities([editembed.pack(a) for a, _, _ in pairs], [editembed.pack(b) for _, b, _ in pairs])
    for (a, b, most), score in zip(pairs, got):
        longer = max(len(a), len(b))
        d = editembed.edit_distance(a, b)
        assert score <= 1 - d / longer + 1e-12 and (score >= editembed.THRESHOLD - 1e-12) == (d <= 0.1 * longer + 1e-9)
    assert not len(editembed.similarities([], []))


def test_pairs_are_refused_before_their_contents_move_or_are_read_whole():
    """Profiles rule out no pair within the threshold, and most pairs of unlike texts; of such a pair few blocks are searched for; what blocks take at least ends a band sooner and changes no distance."""
    random.seed(17)
    codes = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32)
    text = lambda n: " ".join(f"{random.randrange(5000):x}é" for _ in range(n))
    pairs = [("", ""), ("", "é"), ("a", "ab"), ("a" * 3000, "a" * 2800), ("a" * 3000, "a" * 2600)]
    for _ in range(120):
        a = text(random.choice((1, 3, 20, 80, 300)))
        pairs.append((a, _with_character_edits(a, random.choice((0.0, 0.03, 0.08, 0.1, 0.12)))))
    a, b = (editembed.profiles([p[k] for p in pairs]) for k in (0, 1))
    likes = editembed.possible(a, b)
    for (x, y), like in zip(pairs, likes):
        most = int(0.1 * max(len(x), len(y)) + 1e-9)
        d = editembed.edit_distance(x, y)
        assert like or d > most
        ends = editembed._trimmed(x, y)
        refused, (taken,) = editembed._blocks([(*ends, most)])
        assert d > most or not refused[0] and taken.sum() <= d
        for k in () if refused[0] else {most // 2, max(most - 1, 0), most}:
            assert editembed._distance(*ends, k, taken) == (d if d <= k else None), (x, y, k)
    unlike = [text(60) for _ in range(40)]
    assert editembed.possible(editembed.profiles(unlike[:20]), editembed.profiles(unlike[20:])).sum() <= 2
    x, y = codes(text(1500)), codes(text(1500))
    refused, (taken,) = editembed._blocks([(x, y, len(x) // 10)])
    assert refused[0] and np.count_nonzero(taken) <= len(taken) // 2 + 1


def test_lengths_that_the_threshold_rules_out_share_no_bucket():
    """Texts of one fingerprint and 1 to 3,000 characters: each two that may be alike meet in all bands, such as differ by more than a window in none."""
    prints = np.tile(np.arange(editembed.WALKS + 1, dtype=np.uint32), (3001, 1))
    prints[:, editembed.WALKS] = np.arange(3001)
    for threshold in (0.5, 0.9, 1.0):
        found, row = editembed.buckets(prints, threshold)
        own = [set() for _ in range(3001)]
        for b, r in zip(found.tolist(), row.tolist()):
            own[r].add(b)
        for n in range(1, 3001):
            least = math.ceil(threshold * n - 1e-9)
            assert all(len(own[n] & own[k]) >= editembed.WALKS for k in {least, (least + n) // 2, n})
            if threshold > 0.5 and (k := int(n * threshold**editembed.WINDOW * 0.99)):
                assert k == n or not own[n] & own[k]
        assert len(found) < 1.4 * editembed.WALKS * 3001 or threshold == 1.0
    planes = editembed._planes(prints)
    assert (editembed._prints(pa.array([r.tobytes() for r in planes], pa.binary())) == prints).all()
    other = prints[::-1] ^ np.uint32(0x50000)
    other[:, editembed.WALKS] = prints[::-1, editembed.WALKS]
    assert (editembed.estimate_planes(planes[:, : editembed.PLANE], editembed._planes(other)[:, : editembed.PLANE], 0.9) >= editembed.estimate(prints, other, 0.9)).all()


def test_second_bytes_tell_numbers_apart():
    """Two bytes of each number estimate as whole numbers do where these differ in the second byte; the lowest ones alone say more."""
    prints = np.random.default_rng(3).integers(0, 2**32, (200, editembed.WALKS + 1)).astype(np.uint32)
    prints[:, editembed.WALKS] = 500
    other = prints.copy()
    other[:, ::3] ^= np.uint32(0x300)
    other[:, editembed.WALKS] = 500
    a, b = editembed._planes(prints), editembed._planes(other)
    assert np.allclose(editembed.estimate_planes(a[:, : editembed.FINE], b[:, : editembed.FINE]), editembed.estimate(prints, other)) and (editembed.estimate(prints, other) < 0.7).all()
    assert (editembed.estimate_planes(a[:, : editembed.PLANE], b[:, : editembed.PLANE]) == 1).all()



# --- Pipeline


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline
    import sentencepiece

    from millrace.llm import langid, spm

    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "MinHash near-dedup", "benchmark decontamination", "PII", "SentencePiece encoding and decoding"]
    rows = [r for r in docs.collect()]
    coder = langid.Classifier(langid.fit(docs))
    rows = [r for r in rows if coder.classify(r.text)[2]]
    sets, first = grouping.UnionFind(), {}
    for a, b in _jaccard_pairs([(r.doc_id, r.text) for r in rows], minhash.THRESHOLD):
        sets.union(a, b)
    for r in rows:
        if r.text in first:
            sets.union(first[r.text], r.doc_id)
        first.setdefault(r.text, r.doc_id)
    rows = [r for r in rows if sets.find(r.doc_id) == r.doc_id]
    items = [r.text for r in spark.read.parquet(f"{TESTDATA}/benchmark.parquet").collect()]
    texts = {r.doc_id: decontaminate.cut(r.text, [(a, b, []) for a, b in _brute_spans(r.text, items)]) for r in rows}
    texts = {i: pii.replace(t, pii.DEMO_KEY)[0] for i, t in texts.items() if re.search(r"[^\W_]", t)}
    other = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, TESTDATA).collect()}
    assert set(got) == set(texts)
    assert sum(got[i] != other.encode(t) for i, t in texts.items()) == 0


CLASHES = ["__text", "__id", "__key", "__n", "__kept", "__spans", "__cut", "id", "key", "N", "keep", "spans", "new_text", "number", "root", "a.b", "a`b"]


def test_pipeline_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, ties and clashing names through run() and through each stage by itself; empty tables."""
    import corpus_pipeline

    random.seed(12)
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    known = docs.where("length(text) > 300").orderBy("doc_id").limit(60).collect()
    long = " ".join(r.text for r in known if r.lang == "en") * 12
    rows = [(r.doc_id, r.text, r.lang) for r in known] + [(known[0].doc_id, known[0].text, known[0].lang)] * 2 + [(5000, None, "en"), (None, None, None), (5001, "", "en"), (5002, "12 34 !", None), (None, long, None), (5003, long, "en"), (5003, long, "en")]
    wide = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, *range(len(CLASHES))) for r in rows], ", ".join(["doc_id long, text string, lang string, n_chars int", *[f"`{c.replace('`', '``')}` int" for c in CLASHES]]))
    for name, table in (("full", wide), ("empty", wide.limit(0))):
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        bench = spark.read.parquet(f"{TESTDATA}/benchmark.parquet")
        (bench if name == "full" else bench.limit(0)).write.parquet(f"{folder}/benchmark.parquet")
        for stage, function in corpus_pipeline.STAGES[:-1]:
            out = function(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
            assert out.columns == wide.columns and out.dtypes == wide.dtypes, stage
            values = {tuple(r)[4:] for r in out.collect()}
            assert values == ({tuple(range(len(CLASHES)))} if name == "full" else set()), stage
    got = corpus_pipeline.run(spark, str(tmp_path / "full")).collect()
    ids = [r.doc_id for r in got]
    assert len(ids) == len(set(ids)) and not {5000, 5001, 5002} & set(ids) and 5003 in ids and all(r.same and r.n_tokens == len(r.ids) for r in got)
    assert {i for i in ids if i != 5003} <= {r.doc_id for r in known} and len(ids) > 20
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_every_operator_has_a_query():
    assert sorted({int(re.match(r"op(\d+)_", q).group(1)) for q in queries.QUERIES}) == list(range(1, 11))
