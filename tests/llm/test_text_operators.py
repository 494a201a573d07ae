"""Operators on single documents: tokens, sharding, language, HTML, chat, SentencePiece."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from millrace.llm import chat, common, html_blocks, langid, sharding, spm

TESTDATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, key string, tokens int, ids int"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{TESTDATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, columns whose names the operators use."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return spark.createDataFrame([(1, "a b c", "en", "k", 1, 2), (1, "a b c", "en", "k", 1, 2), (2, "", None, None, None, None), (3, None, "en", None, 3, None), (None, "x y z", "en", "k", None, 1), (None, None, None, None, None, None), (4, long, "en", "", 0, 0), (5, " \n\t ", "", "", 0, 0)], DOCS)


def test_tokens_match_a_plain_tokeniser():
    texts = ["Über-cool, été 42!", "", "  a_b  ", "日本語 text", "x"]
    t = common.Tokens(texts)
    plain = [[(m.start(), m.end()) for m in re.finditer("(?:[^\\W_]|́)+", x)] for x in texts]
    for i, spans in enumerate(plain):
        a, b = t.bounds[i], t.bounds[i + 1]
        assert list(zip(t.start[a:b].tolist(), t.end[a:b].tolist())) == spans
    same = common.Tokens(["Word word WORD other", "word"])
    assert len(set(same.hash[[0, 1, 2, 4]].tolist())) == 1 and same.hash[3] != same.hash[0]


def test_chunks_cover_everything_in_order():
    texts = ["a" * n for n in (0, 5, 100, 3, 3)] + [None]
    runs = list(common.chunks(texts, 6))
    assert [x for _, r in runs for x in r] == [t or "" for t in texts]
    assert [f for f, _ in runs] == list(np.cumsum([0] + [len(r) for _, r in runs[:-1]]))


def test_sharding_follows_weights_and_moves_little(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text")
    tree = sharding.uniform_tree({"a": 1.0, "b": 3.0}, racks=2, shards=2)
    rows = sharding.assign(docs, tree).collect()
    assert abs(sum(r.region == "b" for r in rows) / 6000 - 0.75) < 0.03
    assert all(r.shard.startswith(r.rack) and r.rack.startswith(r.region) for r in rows)
    after = {**tree, "b/rack0": {**tree["b/rack0"], "b/rack0/shard1": 2.5}}
    moves = sharding.moved(docs, tree, after).collect()
    assert moves and all(m.shard_before == "b/rack0/shard0" and m.shard_after == "b/rack0/shard1" for m in moves)


def test_sharding_odd_rows(spark, odd):
    rows = sharding.assign(odd).collect()
    assert len(rows) == 8 and all(r.shard for r in rows)
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1
    none = sharding.assign(odd, {"": {"a": 0.0, "b": None}}).collect()
    assert all(r.region is None and r.shard is None for r in none)
    assert sharding.assign(odd.limit(0)).count() == 0


def test_language_held_out(spark, documents):
    train, test = documents.where("doc_id % 2 = 0"), documents.where("doc_id % 2 = 1 AND length(text) > 40")
    rows = langid.classify(test, langid.fit(train)).join(test.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.accepted for r in rows) / len(rows) > 0.98
    assert sum(r.language == r.lang for r in rows if r.accepted) / len(rows) > 0.95


def test_language_odd_rows(spark, odd, documents):
    model = langid.fit(documents)
    rows = langid.classify(odd, model).collect()
    assert len(rows) == 8
    assert all(r.language is None and not r.accepted and r.margin is None for r in rows if r.doc_id in (2, 3, 5))
    wide = odd.withColumn("a.b", odd.doc_id).withColumn("__text", odd.lang)
    assert langid.accepted(wide, model).columns == wide.columns
    kept = {r.doc_id for r in rows if r.accepted}
    assert {r.doc_id for r in langid.accepted(odd, model).collect()} == kept and not kept & {2, 3, 5}
    assert langid.fit(odd.limit(0)) == {} and langid.classify(odd, {}).where("accepted").count() == 0
    assert langid.classify(odd.limit(0), model).count() == 0


def test_language_query_against_brute_force(spark):
    """The query's result is that of plain zstandard calls for every document of sf0.01, and no size of text is treated otherwise."""
    import zstandard

    from millrace.llm import queries

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in queries.op4_language(spark, folder).collect()}
    wrong = 0
    for r in docs.select("doc_id", "text").collect():
        data = re.sub(r"[\W\d_]+", " ", (r.text or "").lower()).strip().encode()
        cost = {}
        for lang, raw in model.items():
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters(write_content_size=0, write_checksum=0, write_dict_id=0, **langid.CODER)
            known.precompute_compress(compression_params=params)
            coder = zstandard.ZstdCompressor(dict_data=known, compression_params=params)
            cost[lang] = sum(len(coder.compress(data[i : i + langid.BLOCK_BYTES])) - 3 for i in range(0, len(data), langid.BLOCK_BYTES))
        best, second = sorted(cost.values())[:2]
        sure = bool(data) and best < second and 1 - best / second >= langid.MARGIN
        want = min(cost, key=cost.get) if sure else None
        wrong += (got[r.doc_id].language, got[r.doc_id].accepted) != (want, sure)
    assert len(got) == docs.count() and wrong == 0


def test_language_dictionaries_are_windows_of_distinct_texts(spark):
    opening = "the same opening in every text of this source " * 20
    rows = [("en", opening + " ".join(f"w{chr(97 + i % 26)}{chr(97 + k % 26)}{chr(97 + i // 26)}" for k in range(600))) for i in range(60)] + [("en", "repeated text " * 50)] * 500
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"), sample=40, size=8_000)
    assert len(model["en"]) <= 8_000 and model["en"].count(b"opening") < 60 and model["en"].count(b"repeated text") < 20


def test_language_ties_are_rejected():
    same = langid.Classifier({"a": b"one two three", "b": b"one two three"})
    assert same.classify("one two three four") == (None, 0.0, False)


def test_html_agrees_with_the_articles(spark):
    right = wrong = missed = 0
    for r in spark.read.parquet(f"{TESTDATA}/pages.parquet").collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r.html).group(1)
        want = [b.text for b in html_blocks.blocks(article)]
        got = (html_blocks.main_text(r.html, html_blocks.default_tree())[0] or "").split("\n")
        right += sum(g in want for g in got)
        wrong += sum(g not in want for g in got)
        missed += sum(w not in got for w in want)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.97


def test_html_blocks_by_hand():
    page = "<html><head><title>no</title></head><body><nav><a href='/x'>Home page</a></nav><p>One &amp; two<br>three <b>four</b></p><!-- no --><script>no()</script><div>five<style>no"
    assert [(b.text, b.words, b.linked) for b in html_blocks.blocks(page)] == [("Home page", 2, 2), ("One & two three four", 4, 0), ("five", 1, 0)]


def test_html_tolerates_odd_attributes():
    for page in ('<p title="oops>Hello there</p>', "<div class=it's>Hello there</div>", '<p title="a > b">Hello there', "<p data-x='<'>Hello there", "<p =>Hello there</p>", "<p title=\"oops>Hello there <a href='x'></a>"):
        text = " ".join(b.text for b in html_blocks.blocks(page))
        assert text.endswith("Hello there") and "oops" not in text and "class" not in text, (page, text)


def test_html_query_against_brute_force(spark):
    """Blocks by the standard library's parser, features and tree by hand, for all pages of sf0.01."""
    from html.parser import HTMLParser

    from millrace.llm import queries

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.now, self.linked, self.link, self.gone = [], "", 0, False, []

        def close_block(self):
            n = len(re.findall(r"\w+(?:['’.-]\w+)*", self.now))
            if n:
                self.out.append((" ".join(self.now.split()), n, self.linked))
            self.now, self.linked = "", 0

        def handle_starttag(self, tag, attrs):
            if tag in html_blocks._GONE.split("|"):
                self.gone.append(tag)
            elif tag in html_blocks._BLOCK:
                self.close_block()
            self.link = self.link or tag == "a"
            self.now += " " if tag == "br" else ""

        def handle_endtag(self, tag):
            if self.gone and tag == self.gone[-1]:
                self.gone.pop()
            elif tag in html_blocks._BLOCK:
                self.close_block()
            self.link = self.link and tag != "a"

        def handle_data(self, data):
            if not self.gone:
                self.now += data
                self.linked += len(re.findall(r"\w+(?:['’.-]\w+)*", data)) if self.link else 0

    def judge(tree, x):
        while not isinstance(tree, bool):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    folder, tree = "/root/testdata/sf0.01", html_blocks.default_tree()
    got = {r.page_id: r for r in queries.op5_html(spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    same = 0
    for r in pages:
        plain = Plain()
        plain.feed(r.html)
        plain.close()
        plain.close_block()
        around = [("", 0, 0), *plain.out, ("", 0, 0)]
        kept = [b[0] for a, b, c in zip(around, around[1:], around[2:]) if judge(tree, [v for _, n, k in (a, b, c) for v in (n, k / max(n, 1))])]
        same += (got[r.page_id].text, got[r.page_id].n_blocks, got[r.page_id].n_kept) == ("\n".join(kept), len(plain.out), len(kept))
    assert len(got) == len(pages) and same == len(pages)


def test_html_tree_is_that_of_brute_force():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 4, (60, 3)).astype(float), rng.random(60) < 0.4
    tree = html_blocks.grow(x, y, depth=1, leaf=5)

    def impurity(f, bound):
        left = x[:, f] <= bound
        return sum(s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (left, ~left))

    options = [(impurity(f, b), f, b) for f in range(3) for b in (0.5, 1.5, 2.5) if min((x[:, f] <= b).sum(), (x[:, f] > b).sum()) >= 5]
    assert abs(impurity(tree[0], tree[1]) - min(options)[0]) < 1e-9


def test_html_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (2, "", "t"), (3, "<p>" + "word " * 50_000, "t"), (None, "<div></div>", None)], "page_id long, html string, text string")
    rows = {r.page_id: r for r in html_blocks.extract(pages).collect()}
    assert rows[1].text is None and rows[2].text == "" and rows[None].n_blocks == 0 and rows[3].n_blocks == 1
    assert html_blocks.extract(pages.limit(0)).count() == 0


def test_chat_marked_transcripts_exactly(spark):
    conversations = spark.read.parquet(f"{TESTDATA}/conversations.parquet")
    model = chat.fit(conversations)
    turns = [("system", "Be brief."), ("user", "How are you?\nReally?"), ("assistant", "Fine, thanks.\n\nNote: all is well."), ("user", "Bye <|im_end|>")]
    for marks in chat.STYLES[:5]:
        raw = "\n\n".join(marks[chat.ROLES.index(r)] + t for r, t in turns)
        got = chat.parse(raw, model)
        assert [r for r, _ in got] == [r for r, _ in turns], raw
        assert got[1][1] == "How are you?\nReally?"
    assert chat.render([("user", "Bye <|im_end|>")]) == "<|im_start|>user\nBye < |im_end|><|im_end|>\n"


def test_chat_loses_no_text(spark):
    """Each turn's text is the source's where the roles are right, and all turns' texts together are the source's in every conversation whose markers are kept or are none."""
    folder = "/root/testdata/sf0.01"
    c = spark.read.parquet(f"{folder}/conversations.parquet")
    model = chat.fit(c)
    turns = {r.conv_id: r.turns for r in chat._turns(c).collect()}
    whole = 0
    for i, known in turns.items():
        raw = "\n\n".join(t.line for t in known)
        got = chat.parse(raw, model)
        # What goes are markers and what separates turns, nothing else.
        strip = lambda texts: re.sub(r"\s", "", "".join(texts))
        lost = len(strip([raw])) - len(strip(t for _, t in got))
        assert lost <= sum(len(re.sub(r"\s", "", t.line)) - len(re.sub(r"\s", "", t.text)) for t in known)
        whole += [t for _, t in got] == [t.text for t in known]
    assert whole / len(turns) > 0.85


def test_chat_keeps_gaps_and_labels(spark):
    model = chat.fit(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    code = "Look:\n\ndef f():\n\n\n    return 1\n\nNote: done.\n\nNote: really."
    got = chat.parse(f"User: Write f.\n\nAssistant: {code}\n\n\nUser: Thanks!\n", model)
    # Turns that are put together again, an empty line between two, give all but the markers, empty lines and indents too.
    assert "\n\n".join(t for _, t in got) == f"Write f.\n\n{code}\n\n\nThanks!\n"
    for text in ("Summary: be brief.\n\nSummary: be clear.", "Summary: be brief.\n\nNote: x.", "Note: a.\nTip: b.\nNote: c.\nTip: d."):
        assert re.sub(r"\s", "", "".join(t for _, t in chat.parse(text, model))) == re.sub(r"\s", "", text)
    story = "Fine, thank you, and you? It is a long story, and I will tell it another time."
    named = chat.parse(f"Alex: How are you?\n\nRobin: {story}\n\nAlex: Tell me more, please, I have time.\n\nRobin: {story}", model)
    assert [t for _, t in named] == ["How are you?", story, "Tell me more, please, I have time.", story]


def test_chat_query_against_brute_force(spark):
    """Viterbi by plain dictionaries over all transcripts of sf0.001 gives the query's roles; equal scores go to the lower state."""
    from millrace.llm import queries

    c = spark.read.parquet(f"{TESTDATA}/conversations.parquet")
    model = chat.fit(c)
    got = {r.conv_id: r for r in queries.op8_chat(spark, TESTDATA).collect()}
    raw = {r.conv_id: r.transcript for r in chat.raw_transcripts(c).collect()}
    assert set(got) == set(raw)
    for i, transcript in raw.items():
        rows = chat.observe(transcript)[3]
        best = {s: (model.start[s] + sum(t[s, rows[0][f]] for f, t in enumerate(model.emit)), [s]) for s in range(6)} if len(rows) else {}
        for row in rows[1:]:
            best = {s: max(((best[p][0] + model.move[p, s] + sum(t[s, row[f]] for f, t in enumerate(model.emit)), [*best[p][1], s]) for p in range(6)), key=lambda x: (x[0], [-v for v in x[1]])) for s in range(6)}
        path = max(best.values(), key=lambda x: (x[0], [-v for v in x[1]]))[1]
        roles = [chat.ROLES[s // 2] for k, s in enumerate(path) if s % 2 == 0 or not k]
        assert list(got[i].roles) == roles and got[i].n_turns == len(roles)


def test_chat_held_out(spark):
    c = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    model, hold = chat.fit(c.where("conv_id % 3 <> 0")), c.where("conv_id % 3 = 0")
    want = {}
    for r in hold.orderBy("conv_id", "turn").collect():
        want.setdefault(r.conv_id, []).append(r.role)
    got = {r.conv_id: list(r.roles) for r in chat.formatted(chat.raw_transcripts(hold), model).collect()}
    assert sum(got[k] == v for k, v in want.items()) / len(want) > 0.85


def test_chat_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    rows = np.stack([rng.integers(0, k, 4) for k in (chat.MARKERS, 2, len(chat._LENGTHS) + 1, 2)], axis=1)
    states = [np.array([0, 1, 2, 4]), np.array([2, 3, 4, 5])]
    model = chat.HMM.fit([(s, rng.permutation(rows)) for s in states])
    import itertools

    def score(path):
        total = model.start[path[0]] + sum(model.move[a, b] for a, b in zip(path, path[1:]))
        return total + sum(table[s, row[f]] for s, row in zip(path, rows) for f, table in enumerate(model.emit))

    best = max(score(p) for p in itertools.product(range(6), repeat=4))
    assert abs(score(model.viterbi(rows)) - best) < 1e-9


def test_chat_odd_rows(spark):
    c = spark.createDataFrame([(1, 0, "user", "Hi", 1), (1, 0, "user", "Hi", 1), (1, None, None, None, 1), (None, 0, "user", "x", 1), (2, 0, "robot", "", 1)], "conv_id long, turn long, role string, text string, n_turns int")
    raw = chat.raw_transcripts(c)
    assert {r.conv_id for r in raw.collect()} == {1, 2}
    model = chat.fit(c)
    rows = {r.conv_id: r for r in chat.formatted(raw, model).collect()}
    assert rows[2].n_turns == 0 and rows[2].text == "" and rows[1].text.count("Hi") == 2
    assert chat.formatted(raw.selectExpr("conv_id", "CAST(NULL AS STRING) AS transcript"), model).where("text IS NULL AND n_turns = 0").count() == 2
    assert chat.raw_transcripts(c.limit(0)).count() == 0 and chat.fit(c.limit(0)).move.shape == (6, 6)


ODD_TEXTS = ["", " ", "  two  blanks ", "a\n\n b\t", "日本語 テスト 😀", "<s> </s> <0x0A> <unk>", "▁x ▁▁ a▁b", "\x00 \x7f", "word " * 5000, " nbsp", "é"]


def test_sentencepiece_parity_and_round_trip(documents):
    texts = [r.text for r in documents.select("text").collect()] + ODD_TEXTS
    coder, other = spm.load(spm.MODEL), sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    for _ in range(2):  # with and without remembered words
        ids, sizes = coder.encode(texts)
        got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == other.encode(texts)
    sizes = np.array([len(x) for x in got])
    back = coder.decode(np.array([i for x in got for i in x], np.int32), sizes)
    assert coder.tokenizer.decode_batch(got, skip_special_tokens=False) == back
    # Ids in any order, bytes that make no character and control pieces among them.
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 400, 3000).astype(np.int32)
    assert coder.decode(ids, np.full(300, 10)) == coder.tokenizer.decode_batch(ids.reshape(300, 10).tolist(), skip_special_tokens=False)
    assert back == other.decode(got) == [t.replace("▁", " ") for t in texts]


def test_sentencepiece_small_cache(monkeypatch):
    monkeypatch.setattr(spm, "CACHE_WORDS", 3)
    coder = spm.Coder(open(spm.MODEL, "rb").read())
    other = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    for texts in (["a b c d"], ["e f g a", "", "x  y"], ["a"]):
        ids, sizes = coder.encode(texts)
        assert ids.tolist() == [i for t in other.encode(texts) for i in t]


#: Pools must outlive what lies in them.
POOLS: list[pa.MemoryPool] = []


def test_sentencepiece_memory_is_a_few_times_the_text():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(5000)]
    texts = [" ".join(rng.choices(vocabulary, k=3000)) for _ in range(100)]
    coder = spm.load(spm.MODEL)
    coder.encode(texts[:1])
    default = pa.default_memory_pool()
    peaks = []
    for step in (coder.encode, coder.decode):
        given = (texts,) if step == coder.encode else result
        POOLS.append(pool := pa.proxy_memory_pool(default))
        pa.set_memory_pool(pool)  # Arrow's memory counts too
        tracemalloc.start()
        result = step(*given)
        peaks.append((tracemalloc.get_traced_memory()[1] + pool.max_memory()) / sum(map(len, texts)))
        tracemalloc.stop()
        pa.set_memory_pool(default)
    assert result == texts and peaks[0] < 11 and peaks[1] < 20, peaks


def test_surrogates_need_no_second_set_of_workers(spark, monkeypatch):
    from pyspark import SparkContext

    from millrace.llm import pii

    docs = spark.createDataFrame([(1, "Write to Anna Keller at a.keller@example.com")], "doc_id bigint, text string").cache()
    docs.count()
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a, **k: pytest.fail("rows go through Python workers"))
    assert pii.collisions(docs).count() >= 0


def _message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += bytes([number << 3 | 2]) if number < 16 else bytes([(number << 3 | 2) & 0x7F | 0x80, number >> 4])
            out += bytes([len(value)]) + value
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + np.float32(value).tobytes()
        else:
            out += (bytes([number << 3]) if number < 16 else bytes([(number << 3) & 0x7F | 0x80, number >> 4])) + bytes([value])
    return out


def test_sentencepiece_unigram_model():
    pieces = [("<unk>", 0.0, 2), *((f"<0x{b:02X}>", -20.0, 6) for b in range(256)), ("▁", -3.0, 1), ("▁ab", -1.0, 1), ("a", -2.5, 1), ("b", -2.6, 1), ("c", -2.0, 1), ("bc", -2.1, 1), ("▁a", -1.5, 1)]
    data = b"".join(b"\x0a" + bytes([len(m)]) + m for m in (_message((1, p.encode()), (2, s), (3, k)) for p, s, k in pieces))
    trainer, norm = _message((3, 1), (35, 1), (40, 0)), _message((1, b"identity"), (3, 1), (4, 0), (5, 1))
    data += b"\x12" + bytes([len(trainer)]) + trainer + b"\x1a" + bytes([len(norm)]) + norm
    other = sentencepiece.SentencePieceProcessor(model_proto=data)
    coder = spm.Coder(data)
    assert spm.parse(data).kind == spm.UNIGRAM and not coder.by_word
    random.seed(0)
    for t in ["abc", "ab c", "a bc é", "", *("".join(random.choice("abc ") for _ in range(12)) for _ in range(50))]:
        assert coder.encode([t])[0].tolist() == other.encode(t), t


def test_sentencepiece_query_round_trip(spark, monkeypatch):
    from millrace.llm import queries

    other = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()}
    rows = queries.op10_sentencepiece(spark, TESTDATA).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.same and r.text == texts[r.doc_id].replace("▁", " ") and list(r.ids) == other.encode(texts[r.doc_id]) for r in rows)
    monkeypatch.setattr(spm.Coder, "encode", lambda self, texts: (np.zeros(0, np.int32), np.zeros(len(texts), np.int64)))
    with pytest.raises(ValueError, match="can't be run"):
        spm.verify(spm.MODEL)


def test_sentencepiece_odd_rows(spark, odd):
    trip = {r.doc_id: r for r in spm.round_trip(odd.where("doc_id IS NOT NULL")).collect()}
    assert trip[3].ids is None and trip[3].text is None and trip[3].same is None and trip[2].text == "" and trip[2].same and trip[4].same
    rows = spm.encode(odd).collect()
    assert len(rows) == 8
    assert all(r.ids is None and r.n_tokens is None for r in rows if r.doc_id == 3) and all(r.ids == [] for r in rows if r.doc_id == 2)
    back = {r.doc_id: r.text for r in spm.decode(spm.encode(odd.where("doc_id IS NOT NULL"))).collect()}
    assert back == {r.doc_id: r.text for r in odd.where("doc_id IS NOT NULL").collect()}
    assert spm.encode(odd.limit(0)).count() == 0
