"""Each operator against a plain version, on fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from planecraft.llm import additive_ann, bpe, compression_rules, language_id, main_text, near_dup, packing, perspectives, quality_classifier, queries, token_files
from planecraft.llm.encoding import encoder
from planecraft.llm.jobs import scratch

ODD = [None, "", " ", "\n\n", "x", "a b c", "same text", "same text", "Hello<|endoftext|>world <|startoftext|> x", "İstanbul Ünal × 3÷4 a×,b", "日本語 text    nb  sp", "é café", "it's don't ' S 'S x's!!", "a1b2 3.14% foo_bar-baz\t\tq\r\n x \n", "x" * 5000, "long words here " * 40_000, "🙂🙃 👩‍👩‍👧", "ΑΣ ΣΑΣ"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    """The small table, odd rows, a repeated row and null columns, with extra columns whose names clash with results."""
    real = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(10_000 + i, t, None if i % 3 else "en", None if i % 2 else "src0", None) for i, t in enumerate(ODD)] + [(None, "no id at all", None, None, 5), (10_005, "a b c", "en", None, None)]
    odd = spark.createDataFrame(rows, real.schema)
    return real.unionByName(odd).withColumn("kept", F.lit("mine")).withColumn("score", F.lit(1)).withColumn("n_words", F.lit("w")).coalesce(3)


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def empty(df):
    return df.limit(0)


def library(name):
    t = Tokenizer.from_file(queries.tokenizer(name))
    t.no_truncation()
    t.no_padding()
    return t


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    marked = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


def test_rules_match_plain_counts(docs, texts):
    bands = compression_rules.Bands()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in compression_rules.assess(docs).collect())
    want = Counter()
    for doc_id, text in texts:
        c = plain_counts(text)
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        raw = (text or "").encode()
        pack = lambda b: len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(b)) / len(b)
        low, high = bands.band(len(raw))
        chunks = [x for i in range(0, len(raw), 4096) if len(x := raw[i : i + 4096]) >= 2048] if len(raw) > 4096 else []
        out = sum(not bands.chunk_low <= pack(x) <= bands.chunk_high for x in chunks)
        want[doc_id, *c, failed, not failed and low <= pack(raw) <= high and out <= bands.chunk_share * max(1, len(chunks))] += 1
    assert got == want
    kept = compression_rules.keep(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(n for k, n in want.items() if k[-1])
    assert compression_rules.assess(empty(docs)).count() == 0


def test_classifier_tells_quality_apart(spark, docs):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    known = labels.where("pmod(xxhash64(doc_id, 5), 4) != 0")
    unseen = quality_classifier.assess(table, known).join(labels.join(known, "doc_id", "left_anti"), "doc_id").select("kept", "quality", "score").toPandas()
    assert (unseen["kept"] == (unseen["quality"] == 1)).mean() > 0.93
    assert unseen["score"].between(0, 1).all()
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, None)], labels.schema))
    scored = quality_classifier.assess(docs, odd)
    assert scored.count() == docs.count() and scored.where("score is null").count() == 0
    assert quality_classifier.assess(docs, empty(labels)).where("kept and score = 0.5").count() == docs.count()
    assert quality_classifier.assess(empty(docs), labels).count() == 0
    assert quality_classifier.keep(docs, labels).columns == docs.columns


def test_language_held_out_accuracy(spark, docs, texts):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.predict(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert set(got["doc_id"]) == {i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97
    und = {r.doc_id for r in language_id.predict(docs).where("lang_pred = 'und'").collect()}
    assert und == {d for d, t in texts if not any(c.isalpha() for c in t or "")}
    assert language_id.predict(empty(docs)).count() == 0


def test_language_profile_is_by_rank():
    how = language_id.Profiles(of_lang=5, of_doc=5)
    grams, counts = language_id.ngrams(language_id.symbols("aab"))
    assert len(grams) == len(set(grams.tolist())) and counts.sum() == 3 + 4 + 3
    judge = language_id.Judge({"xx": grams[:5], "yy": grams[-5:]}, how)
    ranked = grams[np.lexsort((grams, -counts))][:5].tolist()
    apart = {lang: sum(abs(i - p.tolist().index(g)) if g in p.tolist() else 5 for i, g in enumerate(ranked)) for lang, p in (("xx", grams[:5]), ("yy", grams[-5:]))}
    assert judge("aab") == (min(apart, key=apart.get), pytest.approx(1 - min(apart.values()) / 25))


def test_bpe_is_exact(docs, texts):
    t = library("byte_bpe_50k.json")
    got = Counter(tuple(r) for r in bpe.round_trip(docs, queries.tokenizer("byte_bpe_50k.json")).collect())
    want = Counter()
    for doc_id, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[doc_id, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))] += 1
    assert got == want
    own = bpe.encode(docs, queries.tokenizer("byte_bpe_50k.json"))
    assert Counter(tuple(r) for r in bpe.decode(own, queries.tokenizer("byte_bpe_50k.json")).collect()) == Counter((d, x or "") for d, x in texts)
    assert bpe.round_trip(empty(docs), queries.tokenizer("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_units_encode_as_whole_texts(name, kind):
    t, rng = library(name), np.random.default_rng(3)
    signs = ["a", "B", "é", "'", "s", "ll", " ", "  ", "\n", "\t", "1", ".", ",", "×", "ß", "ō", "|", "<", "’", " ", "日"]
    made = ["".join(rng.choice(signs, rng.integers(1, 30))) for _ in range(3000)]
    for text, ids in zip(made, encoder(queries.tokenizer(name), kind)(pa.array(made))):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_token_files(spark, docs, texts):
    t = library("byte_bpe_50k.json")
    path = queries.tokenizer("byte_bpe_50k.json")
    rows = sorted(((d is not None, d or 0, x or "") for d, x in texts), key=lambda r: r[:2])
    got = sorted((tuple(r) for r in token_files.round_trip(docs, path).collect()), key=lambda r: r[1])
    at, want = 0, Counter()
    for known, d, x in rows:
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4")
        want[d if known else None, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r[0], r[2], r[3]) for r in got) == want
    for r in got:
        assert r[1] == at
        at += r[2]
    assert [(r[0] is not None, r[0] or 0) for r in got] == [r[:2] for r in rows]
    form = token_files.Format(length=64, rows=4)
    files = token_files.write(docs, scratch(spark, "tokens"), path, form=form).orderBy("part").collect()
    f = token_files.SequenceFile(files[0].path + ".arrow")
    everything = f.ids(0, files[0].n_tokens)
    for i in range(-(-files[0].n_tokens // 64)):
        ids, mask = f.sequence(i)
        assert ids.base is not None and len(ids) == len(mask) == 64
        assert ids[mask].tolist() == everything[64 * i : 64 * i + 64].tolist()
    assert token_files.round_trip(empty(docs), path).count() == 0


def family(n, edits, seed=5):
    rng = np.random.default_rng(seed)
    words = [f"w{rng.integers(10**9)}" for _ in range(120)]
    out = []
    for i in range(n):
        x = list(words)
        for j in rng.choice(120, edits, replace=False):
            x[j] = f"e{i}x{j}"
        out.append(" ".join(x))
    return out


def plain_classes(rows):
    """Connected components of plain Jaccard similarities of at least 0.8, and of equal texts."""
    sets, root = {}, {}
    for d, t in rows:
        w = WORD.findall(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        root[d] = d
    held, by = defaultdict(list), dict(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        for g in s or {("empty", by[d])}:
            held[g].append(d)
    for group in held.values():
        for b in group:
            a = group[0]
            for a in group:
                if a < b and find(a) != find(b) and (by[a] == by[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                    root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in root}


def test_near_duplicates(spark, docs, texts):
    made = [(20_000 + i, t) for i, t in enumerate(family(60, 1) + family(3, 30, 9) + family(60, 2, 11))]
    more = docs.unionByName(spark.createDataFrame([(d, t) for d, t in made], "doc_id long, text string"), allowMissingColumns=True)
    got = {}
    for r in near_dup.classes(more).collect():
        if r.doc_id is None:
            assert r.class_id is None
        else:
            assert got.setdefault(r.doc_id, r.class_id) == r.class_id
    want = plain_classes([(d, t) for d, t in texts + made if d is not None and t is not None])
    assert {d: got[d] for d in want} == want
    assert got[10_000] == 10_000  # null text
    assert len({got[20_000 + i] for i in range(60)}) == 1 and len({got[20_060 + i] for i in range(3)}) == 3
    kept = near_dup.keep(more)
    assert kept.columns == more.columns
    assert {r.doc_id for r in kept.collect()} == {None, *got.values()}
    assert near_dup.classes(empty(docs)).count() == 0


def test_overlaps_of_all_pairs():
    rng = np.random.default_rng(0)
    pool = np.unique(rng.integers(1, 1 << 63, 300, dtype=np.uint64))
    sets = []
    for _ in range(60):
        h = np.sort(rng.choice(pool, rng.integers(1, 200), replace=False))
        sets.append((h, (rng.integers(1, 5, len(h)) * (1 + (h % np.uint64(97)) / 97)).astype(np.float32)))
    heavy, plain = near_dup.overlaps(sets, common=12, columns=64)
    for a in range(60):
        for b in range(a + 1, 60):
            _, x, y = np.intersect1d(sets[a][0], sets[b][0], return_indices=True)
            assert plain[a, b] == len(x) and heavy[a, b] == pytest.approx(np.minimum(sets[a][1][x], sets[b][1][y]).sum(dtype=float))


def test_large_buckets_lose_no_link(spark):
    """A family near the threshold: many members are linked with few others, and to no common centre."""
    rng, rows = np.random.default_rng(3), []
    for d in range(150):
        x = [f"w{i}" for i in range(120)]
        for j in rng.choice(20, 4, replace=False) * 5:
            x[j] = f"edit{j}"
        rows.append((d, " ".join(x)))
    sets = [{tuple(w[i : i + 5]) for i in range(116)} for w in (t.split() for _, t in rows)]
    want = list(range(150))
    for b in range(150):
        for a in range(b):
            if want[a] != want[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                want = [min(want[a], want[b]) if c in (want[a], want[b]) else c for c in want]
    assert len(set(want)) == 27
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for how in (near_dup.Weighted(), near_dup.Weighted(all_pairs=4, block_texts=16)):
        assert dict(near_dup.classes(docs, how).collect()) == dict(enumerate(want))


def test_weighted_samples_meet_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 1 << 63, 400, dtype=np.uint64)
    a, b = rng.uniform(1, 2, 400), rng.uniform(1, 2, 400)
    a[350:], b[:50] = 0, 0
    one = near_dup.signature(h[a > 0], a[a > 0].astype(np.float32), 4096)
    two = near_dup.signature(h[b > 0], b[b > 0].astype(np.float32), 4096)
    assert (one == two).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 105), (103, 105)]
    got = {r.node: r.root for r in near_dup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 105: 100, 103: 100}
    assert near_dup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ann_recall_and_order(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(90_000, None), (90_001, []), (90_002, [0.0] * 64), (90_003, [float("nan")] * 64), (90_004, [None] * 64), (90_005, [1.0, 2.0]), (90_020, [2.0, 1.0])]
    copies = [(91_000 + i, [0.25] * 64) for i in range(40)]
    vectors = table.select("vec_id", "embedding").unionByName(spark.createDataFrame(rows + copies, "vec_id long, embedding array<float>")).withColumn("score", F.lit("clash"))
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in additive_ann.valid(vectors).collect()}
    assert not {90_000, 90_001, 90_002, 90_003, 90_004} & set(x)
    got = defaultdict(list)
    for r in sorted(additive_ann.search(vectors, F.col("vec_id") % 20 == 0).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), abs=1e-12)
    hits = total = 0
    for q in (i for i in x if i % 20 == 0):
        exact = sorted((-float(x[q] @ v), i) for i, v in x.items() if i != q and len(v) == len(x[q]))[:20]
        assert len(got[q]) == len(exact) and q not in dict(got[q])
        hits, total = hits + len({i for _, i in exact} & set(dict(got[q]))), total + len(exact)
    assert hits / total >= 0.9
    assert [i for i, _ in got[91_000]] == list(range(91_001, 91_021))
    assert additive_ann.search(empty(vectors), F.col("vec_id") % 20 == 0).count() == 0


PAGE = "<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home</li></ul></nav><div class='ad'>Buy <p>now</div>%s<form>q</form><footer>&copy; x</footer></body></html>"


def test_main_text(spark):
    filler = " ".join(f"menu{i}" for i in range(40))
    pages = [
        (1, "http://a.org/1", PAGE % "<!-- c --><article><h1>One&nbsp; two</h1><p>a<b>b</b>\n c &amp; d<p class=notice>gone<p>last<br>x<div id='comments'>talk</div></article><p>after"),
        (2, "http://a.org/2", PAGE % f"<div>{filler}</div><p>first story stays</p>"),
        (3, "http://a.org/3", PAGE % f"<div>{filler}</div><p>second story is here</p>"),
        (4, None, None),
        (5, "odd", ""),
        (6, "http://b.org/", "plain <script>var t='</p>'</script> words < 3 &lt;x&gt;"),
        (6, "http://b.org/", "plain <script>var t='</p>'</script> words < 3 &lt;x&gt;"),
    ]
    got = Counter(tuple(r) for r in main_text.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(3))).collect())
    texts = {1: "One two ab c & d last x", 2: "first story stays", 3: "second story is here", 4: "", 5: "", 6: "plain words < 3 <x>"}
    assert got == Counter((p, u, texts[p], len(texts[p])) for p, u, _ in pages)


def test_covered_matches_plain_search():
    rng = np.random.default_rng(2)
    streams = [rng.integers(0, 3, n) for n in (60, 0, 45, 7, 80)]
    for run in (3, 4, 7):
        where = defaultdict(set)
        for p, s in enumerate(streams):
            for i in range(len(s) - run + 1):
                where[tuple(s[i : i + run])].add(p)
        for s, hit in zip(streams, main_text.covered(streams, run)):
            want = np.zeros(len(s), bool)
            for i in range(len(s) - run + 1):
                if len(where[tuple(s[i : i + run])]) > 1:
                    want[i : i + run] = True
            assert hit.tolist() == want.tolist()


def test_perspectives_lay_out_dialogues(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    odd = spark.createDataFrame([(900, None, "Ann", "hi"), (900, 1, None, None), (900, 1, None, None), (900, 2, "system", "s"), (None, 0, "Bob", "x"), (901, 0, "system", "alone")], "conv_id long, turn long, role string, text string")
    both = table.select("conv_id", "turn", "role", "text").unionByName(odd)
    frame = perspectives.rotate(both.withColumn("position", F.lit(0)), perspectives.Template(block=2))
    conversations = both.toArrow()  # noqa: F841
    want = duckdb.connect().sql(perspectives.ROTATE_SQL)
    assert frame.columns == want.columns
    assert Counter(tuple(r) for r in frame.collect()) == Counter(want.fetchall())
    got = frame.toPandas()
    for _, g in got.groupby(["conv_id", "perspective"], dropna=False):
        g = g.sort_values("position")
        assert "".join(g["rendered"]).count("<|im_start|>assistant") == (g["role"] == "assistant").sum() > 0
        assert g["char_start"].iloc[0] == 0 and (g["char_start"].iloc[1:].values == g["char_end"].iloc[:-1].values).all()
    assert perspectives.rotate(empty(both)).count() == 0


def check_pieces(rows, texts, t):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
    want = defaultdict(list)
    for d, x in texts:
        want[d].append([*t.encode(x or "", add_special_tokens=False).ids, 1])
    assert set(by_doc) == set(want)
    for d, rs in by_doc.items():
        if len(want[d]) == 1:
            ids, at = np.array(want[d][0], "<u4"), 0
            for r in sorted(rs, key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
        else:
            assert sum(r.length for r in rs) == sum(map(len, want[d]))
    padding = sum(2048 - sum(r.length for r in rs) for rs in by_sequence.values())
    assert padding <= 2048 * 4


def test_packing(docs, texts):
    how = packing.Packing(queries.tokenizer("word_bpe_49k.json"))
    check_pieces(packing.pack(docs, how).collect(), texts, library("word_bpe_49k.json"))
    assert packing.pack(empty(docs), how).count() == 0


def test_hilbert_steps_to_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_pipeline_is_its_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules = {r.doc_id for r in compression_rules.assess(docs).where("kept").collect()}
    left = docs.where(F.col("doc_id").isin(list(rules)))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in quality_classifier.assess(left, labels).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in left.collect() if r.doc_id in good]
    unique = set(plain_classes(rows).values())
    packed = corpus_pipeline.run(spark, sf).collect()
    check_pieces(packed, [(d, t) for d, t in rows if d in unique], library("word_bpe_49k.json"))
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rules & {d for d, q in known.items() if q}) > 0.95 * sum(known.values())
