"""The training-data operators on small tables, against brute force and on edge cases."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from swarmframe.llm import bpe_automaton, html_text, language_model, mixing, neighbours, ngram_join, pu_quality, quality_rules, toxicity, wavelet

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, key int, taken int, label string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, repeated and null ids, names that operators use themselves."""
    base = "the quick brown fox jumps over the lazy dog and runs far away into the dark green wood " * 5
    rows = [(1, base), (2, base), (3, None), (4, ""), (5, "one"), (6, "two words"), (7, "word " * 30_000), (8, base + "extra"), (9, " \t\n "), (10, "É 中文 😀 ﬁ x <|endoftext|> \x1c"), (10, "É again"), (None, "no id at all here"), (1, base), (11, base.replace("fox", "cat", 1))]
    return spark.createDataFrame([(i, t, "en", None if k % 3 == 0 else f"s{k % 2}", 0, "x", "y", 1, 2, "z") for k, (i, t) in enumerate(rows)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def words(t):
    return WORD.findall(t or "")


def test_html():
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><div class='ad'>Buy, now</div><article><h1>A &amp; B</h1><p>First,\n  line.<br><p><b>Second</p><div class=comments><p>No, never</p></div></article><aside>side</aside><footer>&copy; x</footer>"
    assert html_text.extract(page) == "A & B\nFirst, line.\nSecond"
    for odd in (None, "", "<", "<p", "<!-- x", "<script>1", "&am", "</p></p>"):
        html_text.extract(odd)
    assert html_text.extract(None) == "" and html_text.extract("<nav>a</nav>") == ""


def test_html_keeps_all_of_an_article():
    long = "".join(f"<p>Line {k}, one, two, three of a long section.</p>" for k in range(10))
    menu = '<div><a href="/a">Home</a> <a href="/b">All pages</a></div>'
    article = f"<h1>Title</h1><p>Lead</p><section>{long}</section><section><p>Short end.</p></section>"
    want = ["Title", "Lead", *[f"Line {k}, one, two, three of a long section." for k in range(10)], "Short end."]
    for page in (f"<body>{menu}<article>{article}</article>", f"<body>{menu}<main>{article}</main>", f"<body>{menu}<div>{article}</div>", f"<body>{menu}<div><h1>Title</h1><p>Lead</p><div><section>{long}</section></div><div>Short end.</div></div>"):
        assert html_text.extract(page).split("\n") == want
    for attributes in ('style="overflow:hidden"', "data-hidden='1'", "data-role=menu", 'title="class=nav"', "data-class=ad", "href=/id=menu"):
        assert html_text.extract(f"<article><div {attributes}>Some text, kept.</div></article>") == "Some text, kept."
    for attributes in ("hidden", "HIDDEN=''", 'data-x="1" aria-hidden=true', "Role='menu'", "CLASS=nav", 'style="a" id="side-menu"'):
        assert html_text.extract(f"<article><p>Kept.</p><div {attributes}>Gone.</div></article>") == "Kept."


def test_mixing(docs, edge, empty):
    for table in (docs, edge):
        rows = mixing.mix(table).collect()
        given = table.select("doc_id", "text", "source").collect()
        assert len(rows) == len(given) and Counter((r["doc_id"], r["size"]) for r in rows) == Counter((g["doc_id"], len(words(g["text"]))) for g in given)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
        sizes = Counter()
        for g in given:
            sizes[g["source"]] += len(words(g["text"]))
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight, total = {s: k % 3 + 1 for k, s in enumerate(order)}, sum(sizes.values())
        target, open_, left = {}, set(order), float(total)
        while True:  # shares again and again until none is above
            level = left / sum(weight[s] for s in open_)
            full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
            if not full:
                break
            for s in full:
                target[s] = 3.0 * sizes[s]
                left -= target[s]
            open_ -= full
        target |= {s: level * weight[s] for s in open_}
        got = Counter(round(r["target"], 4) for r in rows)
        assert got == Counter(round(target[g["source"]], 4) for g in given)
        assert sum(r["taken"] for r in rows) == pytest.approx(total, abs=len(order))
    assert mixing.mix(empty).count() == 0
    again = mixing.mix(docs).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()))
    taken = sum(r["taken"] for r in mixing.mix(edge).collect())
    copies = mixing.repeated(edge)
    assert copies.columns == edge.columns and sum(len(words(r["text"])) for r in copies.collect()) == taken


def test_language_model(docs, edge, empty):
    for table in (docs, edge):
        rows = language_model.score(table, language_model.fit(table, epochs=1)).collect()
        given = [(r["doc_id"], [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode())] + [0]) for r in table.collect()]
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        c = Counter(w for i, ws in given if not held(i) for w in ws)
        n, v = sum(c.values()), len(c)
        want = Counter((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, ws in given)
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows) == want
        assert all(r["score"] < 0 for r in rows)
    assert language_model.score(empty).count() == 0
    scored = language_model.score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert scored[0] > scored[1]


def test_language_model_counts_once(edge, monkeypatch):
    """A model that score fits itself has counted the texts; for another model they are counted again."""
    model, counted, count = language_model.fit(edge, epochs=1), [], language_model._counts
    monkeypatch.setattr(language_model, "fit", lambda docs: model)
    monkeypatch.setattr(language_model, "_counts", lambda *a: counted.append(1) or count(*a))
    rows = lambda df: Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())
    own = rows(language_model.score(edge))
    assert not counted
    assert own == rows(language_model.score(edge, model)) and counted


def test_language_model_learns_from_all_texts(spark):
    rows = [(i, f"the w{i} stays here") for i in range(2_700)]
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    model = language_model.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), epochs=1)
    assert len(model.vocabulary.keys) == len(train) + 4 == model.gru.head
    moved = (model.gru.p["emb"] != language_model.Gru(model.gru.head).p["emb"]).any(axis=1)
    assert moved[1 : model.gru.head].all()


def test_gru_sums_to_one():
    g = language_model.Gru(70)
    h = np.random.default_rng(0).standard_normal((3, language_model.HIDDEN)).astype(np.float32)
    total = sum(np.exp(g.log_probs(h, np.full(3, k))[0]) for k in range(70 + language_model.TAILS))
    assert np.allclose(total, 1, atol=1e-4)


def test_toxicity():
    a = toxicity.build_automaton(["idiot", "scum"], ["vequ"], {"idiom", "scams"})
    kind = lambda w: int(a.run(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0])
    assert [kind(w) for w in ("idiot", "idi0t", "idot", "idiott", "idiom", "scum", "scam", "vequxyz", "veq", "")[:9]] == [1, 2, 2, 2, 0, 1, 0, 1, 0]
    import pyarrow as pa

    from swarmframe.llm.textbuf import text_buffer

    _, hits = toxicity.hit_features(*text_buffer(pa.array(["you idiot", 'he said "idiot" to me', None, "IDIOT!"])), a)
    assert hits["doc"].tolist() == [0, 1, 3] and hits["quoted"].tolist() == [False, True, False]


def test_toxicity_reads_letters():
    import pyarrow as pa

    from swarmframe.llm.textbuf import text_buffer

    a = toxicity.build_automaton(["estúpido", "idiota"], [], set())
    given = ["¡idiota!", "x “idiota” y", "idiota…", "«\u00a0idiota\u00a0»", "a—idiota—b", "ESTÚPIDO", "Ωidiota", "idïota", "estupido", "éstúpido", "estúpidoé", "éstupido", "idïot\u00aa", "中文 😀 Ã 𐐀", ""]
    data, offsets = text_buffer(pa.array(given))
    codes, first = toxicity.code_points(data, offsets)
    assert "".join(map(chr, codes)) == "".join(given) and len(first) == len(codes)
    _, hits = toxicity.hit_features(data, offsets, a)
    found = [(int(d), data[s:e].tobytes().decode(), int(k)) for d, s, e, k in zip(hits["doc"], hits["start"], hits["end"], hits["kind"], strict=True)]
    exact = [(k, "idiota", 1) for k in range(5)] + [(5, "ESTÚPIDO", 1)]
    assert found == [*exact, (6, "Ωidiota", 2), (7, "idïota", 2), (8, "estupido", 2), (9, "éstúpido", 2), (10, "estúpidoé", 2)]
    broken = np.frombuffer(b"\xa9 idiota \xc3 idiota\xf0\x9f idiota \xff", np.uint8)
    assert len(toxicity.hit_features(broken, np.array([0, len(broken)]), a)[1]["doc"]) == 3


def test_learned_toxicity(spark, edge, empty):
    rng = np.random.default_rng(1)
    pool = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "green", "house", "light"]
    rows = []
    for i in range(300):
        ws = list(rng.choice(pool, 40))
        if i % 5 == 0:
            ws[7] = ws[19] = ("nastyword", "vilestem" + "abcdefgh"[i // 5 % 8] * 2)[i % 2]
        rows.append((i, " ".join([*ws, f"u{i}"]), int(i % 5 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(table)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.apply(table, model).collect()}
    assert all(got[i] == y for i, _, y in rows)
    assert toxicity.apply(edge, model).where("predicted = 1").count() == 0 and toxicity.apply(edge, model).count() == edge.count()
    none = toxicity.fit(table.limit(0))
    assert toxicity.apply(empty, none).count() == 0


def test_quality_rules(docs, edge, empty):
    model = quality_rules.fit(docs, docs.select("doc_id", "text", (~F.col("text").contains("***")).cast("int").alias("label")))
    for table in (docs, edge):
        got = Counter(tuple(r) for r in quality_rules.apply(table, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
        want = Counter()
        for r in table.collect():
            t = r["text"] or ""
            ws, lines, seen = words(t), 0, set()
            for line in t.split("\n"):
                if words(line):
                    lines += line in seen
                    seen.add(line)
            windows = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
            many = Counter(windows)
            covered = {k + j for k, w in enumerate(windows) if many[w] > 1 for j in range(3)}
            want[(r["doc_id"], len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), lines, len(covered))] += 1
        assert got == want
    kept = quality_rules.apply(docs, model).where("NOT base_failed").join(docs.select("doc_id", "text"), "doc_id")
    assert kept.where("kept AND text LIKE '%***%'").count() == 0
    assert quality_rules.apply(empty, quality_rules.fit(empty, empty.select("doc_id", "text", F.lit(1).alias("label")))).count() == 0


def test_wavelet(docs, edge, empty):
    encode = wavelet.id_encoder(None).library.encode
    for table in (docs, edge):
        shards = wavelet.write_shards(table, shard_ids=5_000)
        got = wavelet.read_documents(shards).orderBy("start").collect()
        given = sorted(((r["doc_id"], r["text"] or "") for r in table.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
        at, want = 0, []
        for i, t in given:
            ids = [*encode(t, add_special_tokens=False).ids, 0]
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert [tuple(r) for r in got] == want
    assert wavelet.read_documents(wavelet.write_shards(empty)).count() == 0
    ids = np.random.default_rng(2).integers(0, 300, 1000)
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix(ids, np.array([0, 1000]), np.array([7]), np.array([True])).to_bytes())
    assert (m.ids() == ids).all() and [m.access(i) for i in range(50)] == ids[:50].tolist()
    for t in (5, 299, 400):
        assert m.count(t, 10, 900) == (ids[10:900] == t).sum() and (m.occurrences(t) == np.flatnonzero(ids == t)).all()


def test_pieces_of_any_text(monkeypatch):
    """Ids are the library's wherever texts are cut, also after pieces were forgotten."""
    rng = np.random.default_rng(11)
    signs = [" ", " ", *"\n\t\r\v\f", "a", "the", "s", "t", "'", "'s", "'ll", "1", "42", *",.&@[`{/:09zZ", "!!", "é", "ÿ", "ſ", "À", "x" * 23, "y" * 40, "+" * 25]
    odd = ["中", "\u00a0", "\u2028", "\x00", "\x1c", "<|endoftext|>", "😀", "²"]
    encoder = wavelet.id_encoder(None)
    for kept in (50, 2_000, wavelet.PIECES_KEPT):
        monkeypatch.setattr(wavelet, "PIECES_KEPT", kept)
        for _ in range(40):
            texts = ["".join(rng.choice(signs, rng.choice([0, 1, 2, 5, 30, 200]))) + (str(rng.choice(odd)) if rng.random() < 0.1 else "") for _ in range(rng.choice([0, 1, 2, 40]))]
            assert [x.tolist() for x in encoder.many(texts)] == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_known_pieces_cost_less_than_cutting_them_one_by_one(docs):
    """CPU seconds of texts whose pieces are all known, against those of a regular expression that only finds the pieces."""
    texts = [t for r in docs.collect() for t in [r["text"] or ""] if t.isascii()]
    encoder, piece = wavelet.id_encoder(None), re.compile(rb" ?[A-Za-z]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")

    def least(work):
        took = []
        for _ in range(7):
            began = time.thread_time()
            work()
            took.append(time.thread_time() - began)
        return min(took)

    assert least(lambda: encoder.many(texts)) < least(lambda: [piece.findall(t.encode()) for t in texts])


def brute_components(rows, n, percent):
    sets = []
    for _, t in rows:
        ws = (t or "").encode().lower().split()
        sets.append({tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set()))
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        s, t = sets[a], sets[b]
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(sets[k]), least.get(find(k), i) if sets[k] else i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, n, percent):
    rng = np.random.default_rng(n)
    rows = []
    for g in range(12):
        base = [f"w{rng.integers(400)}" for _ in range(int(rng.integers(8, 90)))]
        for _ in range(5):
            ws = list(base)
            for _ in range(int(rng.integers(0, 4))):
                ws[int(rng.integers(len(ws)))] = f"x{rng.integers(1000)}"
            rows.append((len(rows), " ".join(ws)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.ngram_components(table, n, percent).select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, got.collect())) == brute_components(rows, n, percent)


def test_ngram_join_edges(edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    got = ngram_join.ngram_components(edge, 3, 90).select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, got.collect())) == brute_components(rows, 3, 90)
    assert ngram_join.ngram_components(empty).count() == 0


def test_pigeonhole_levels():
    for percent in (80, 90):
        levels = ngram_join.Levels(percent, 400)
        for a in range(1, 300):
            for b in range(a, 100 * a // percent + 1):
                k, m = levels.of(np.array([a, b]))
                assert m - k <= 1
                differ = a + b - 2 * math.ceil(percent * (a + b) / (100 + percent))
                assert differ <= 0 or levels.parts[k] > differ + levels.spare[k] - 1


def test_pu_classifier(docs, edge, empty):
    label = docs.select("doc_id", "text", (~F.col("text").rlike(r"\*\*\*|!!| \| ")).cast("int").alias("label"))
    model = pu_quality.fit(label.where("doc_id % 4 <> 2"), docs)
    rows = pu_quality.apply(docs, model).join(label, "doc_id").where("doc_id % 4 = 2").collect()
    assert np.mean([r["predicted"] == r["label"] for r in rows]) > 0.85
    scores = [r["score"] for r in pu_quality.apply(edge, model).collect()]
    assert len(scores) == edge.count() and all(0 <= s <= 1 for s in scores)
    nothing = pu_quality.fit(empty.select("doc_id", "text", F.lit(1).alias("label")), empty)
    assert pu_quality.apply(edge, nothing).count() == edge.count()


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((400, 16)).astype(np.float32)
    v[50:80] = v[50]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (None, [1.0] * 16, 0), (1003, [1.0, None] * 8, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = neighbours.nearest(table, F.col("vec_id") % 20 == 0, 20).collect()
    full = v.astype(float)
    hits = 0
    for q in range(0, 400, 20):
        s = neighbours.exact(full, full[q])
        s[q] = -np.inf
        best = np.lexsort((np.arange(400), -s))[:20]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert len(mine) == 20
        hits += sum(r["vec_id"] == b and r["score"] == s[b] for r, b in zip(mine, best, strict=True))
    assert hits >= 0.9 * 400
    assert neighbours.nearest(table.limit(0), F.lit(True)).count() == 0


def test_neighbours_of_several_lengths(spark):
    v = np.random.default_rng(5).standard_normal((60, 8))
    table = spark.createDataFrame([(i, x[: 8 - 3 * (i % 2)].tolist()) for i, x in enumerate(v)] + [(99, [1.0] * 30)], "vec_id long, embedding array<double>").repartition(2)
    got = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(table, F.col("vec_id") < 4, 3).collect())
    want = Counter()
    for q in range(4):
        ids = np.array([i for i in range(q % 2, 60, 2) if i != q])
        full = v[:, : 8 - 3 * (q % 2)]
        s = neighbours.exact(full[ids], full[q])
        want.update((q, k + 1, int(ids[j]), float(s[j])) for k, j in enumerate(np.argsort(-s)[:3]))
    assert got == want


def test_bpe(docs, edge, empty):
    library = bpe_automaton.encoder(bpe_automaton.default_path()).library
    for table in (docs, edge):
        got = Counter(tuple(r) for r in bpe_automaton.digests(table).collect())
        want = Counter()
        for r in table.collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            want[(r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
        assert got == want
    assert bpe_automaton.digests(empty).count() == 0


def test_pipeline(spark, sf, edge, empty):
    import corpus_pipeline

    for table in (edge, empty):
        rows = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, sf)
            assert rows.columns == table.columns, name
        assert rows.count() >= 0
    given = spark.read.parquet(f"{sf}/documents.parquet")
    left = corpus_pipeline.one_of_near_duplicates(spark, given, sf)
    want = brute_components([(r["doc_id"], r["text"]) for r in given.collect()], 5, 80)
    assert {r["doc_id"] for r in left.collect()} == {c for _, _, c in want}


def test_pipeline_keeps_one_row_of_each_group(spark, sf):
    import corpus_pipeline

    texts = {c: " ".join(f"{c}{k}" for k in range(60)) for c in "abcdef"}
    near = {c: t + " more" for c, t in texts.items()}
    rows = [(None, texts["a"]), (None, near["a"]), (None, texts["b"]), (1, texts["c"]), (2, near["c"]), (None, texts["c"]), (5, texts["d"]), (4, near["d"]), (5, texts["e"]), (7, texts["f"]), (7, near["f"]), (8, ""), (None, None)]
    table = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, key int")
    left = corpus_pipeline.one_of_near_duplicates(spark, table, sf)
    got = Counter((r["doc_id"], (r["text"] or "")[:1]) for r in left.collect())
    assert got == Counter([(None, "a"), (None, "b"), (1, "c"), (4, "d"), (5, "e"), (7, "f"), (8, ""), (None, "")])


def test_prior_without_negatives():
    rng = np.random.default_rng(7)
    bins = lambda x: np.bincount(np.clip(x, 0, pu_quality.BINS - 1).astype(int), minlength=pu_quality.BINS)
    for prior in (0.2, 0.5, 0.9):
        n = int(20_000 * prior)
        positive, mixed = rng.normal(280, 40, 4_000), np.concatenate([rng.normal(280, 40, n), rng.normal(120, 40, 20_000 - n)])
        assert abs(pu_quality.estimate_prior(bins(positive), bins(mixed)) - prior) < 0.05


def test_pu_learns_from_every_text(spark):
    """A mark that only texts far behind in the table have moves the weights."""
    rows = [(i, f"plain words number {i} of a text " * 3 + ("~~~~~~~~ " * 20 if i >= 3_900 else ""), 1 if i < 60 else 0) for i in range(4_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    model = pu_quality.fit(table.where("doc_id < 60"), table)
    got = {r["doc_id"]: r["score"] for r in pu_quality.apply(table.where("doc_id < 60 OR doc_id >= 3900"), model).collect()}
    assert max(got[i] for i in range(3_900, 4_000)) < min(got[i] for i in range(60))


def test_ngram_join_of_a_drifted_family(spark):
    """Near copies that don't link with each other share a bucket; pairs that can't link are not compared."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(90):
        ws = list(base)
        for at in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            ws[at] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(ws)))
    rows += [(90 + i, " ".join([*base[:60], *[f"y{i}_{k}" for k in range(80)]])) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.ngram_components(table, 3, 90).select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, got.collect())) == brute_components(rows, 3, 90)
    signed = ngram_join.signatures(table, 3)
    assert ngram_join.set_groups(table, signed, 3, 90).count() == len({t for _, t in rows})


def test_linked_sets_share_the_parts_they_need():
    rng = np.random.default_rng(11)
    for percent in (80, 90):
        for size in (9, 15, 40, 150, 700):
            for _ in range(6):
                a = rng.integers(1, 1 << 62, size, dtype=np.uint64)
                b = a.copy()
                differ = size * (100 - percent) // (100 + percent)
                b[:differ] = rng.integers(1, 1 << 62, differ, dtype=np.uint64)
                assert 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
                tokens, offsets = ngram_join.sets_by_doc(np.repeat([0, 1], size), np.concatenate([a, b]), 2)
                keys, owner, level = ngram_join.part_keys(tokens, offsets, percent)
                levels = ngram_join.Levels(percent, 1 << 20)
                own = int(levels.of(np.array([size]))[0])
                if differ:
                    shared = np.intersect1d(keys[(owner == 0) & (level == own)], keys[(owner == 1) & (level == own)])
                    assert len(shared) >= levels.need[own]


def test_rank_and_select():
    rng = np.random.default_rng(9)
    for n in (1, 63, 64, 65, 511, 512, 513, 5_000):
        for share in (0.0, 0.03, 0.5, 1.0):
            bits = rng.random(n) < share
            plane = wavelet.Plane.of(bits)
            assert (plane.bits() == bits).all() and plane.zeros == n - bits.sum()
            for i in {0, n, *rng.integers(0, n + 1, 20).tolist()}:
                assert plane.rank(i) == bits[:i].sum()
            for one in (True, False):
                places = np.flatnonzero(bits == one)
                assert (plane.select(np.arange(len(places)), one) == places).all()
    for ids in (np.zeros(700, int), np.arange(3), np.array([65_000, 7, 7])):
        m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix(ids, np.array([0, len(ids)]), np.array([1]), np.array([True])).to_bytes())
        assert (m.ids() == ids).all() and all((m.occurrences(t) == np.flatnonzero(ids == t)).all() for t in set(ids.tolist()))


def test_compiled_automaton():
    """Arcs are there iff merging by rank leaves the two tokens as they are."""
    merges = [("a", "b"), ("b", "a"), ("a", "a"), ("ab", "ab"), ("aa", "a"), ("ab", "a"), ("c", "ab"), ("b", "c"), ("aa", "aa"), ("ba", "ba"), ("c", "c"), ("cc", "c")]
    vocab = {t: i for i, t in enumerate(["a", "b", "c", *dict.fromkeys(u + v for u, v in merges)])}
    rank = {m: k for k, m in enumerate(merges)}

    def plain(word):
        parts = list(word)
        while True:
            found = min(((rank[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank), default=None)
            if not found:
                return parts
            parts[found[1] : found[1] + 2] = ["".join(parts[found[1] : found[1] + 2])]

    a = bpe_automaton.MergeAutomaton(vocab, merges)
    name = {i: t for t, i in vocab.items()}
    real = [t for t in vocab if plain(t) == [t]]
    for t in real:
        for x in real:
            assert a.arc(vocab[t], vocab[x]) == (plain(t + x) == [t, x]), (t, x)
    rng = np.random.default_rng(3)
    for n in range(1, 14):
        for _ in range(60):
            word = "".join(rng.choice(list("abc"), n))
            assert [name[i] for i in a.encode(word)] == plain(word), word


def test_few_exact_products(monkeypatch):
    """Where a bar leaves much of a block, only what may be among the k best is reranked, and the k best are those of all."""
    rng = np.random.default_rng(7)
    vectors, query = rng.standard_normal((4_096, 64)).astype("<f4"), rng.standard_normal(64)
    center = vectors.mean(axis=0).astype(float)
    codes, scalar, length = neighbours.encode(vectors - center)
    block = neighbours.Block({"d": 64, "kind": "<f4", "ids": np.arange(4_096).tobytes(), "vectors": vectors.tobytes(), "center": center.tobytes(), "codes": codes.tobytes(), "scalar": scalar.tobytes(), "length": length.tobytes()})
    want = neighbours.exact(vectors.astype(float), query)
    best = np.lexsort((np.arange(4_096), -want))[:20]
    size, asked, exact = float(np.linalg.norm(query)), [], neighbours.exact
    monkeypatch.setattr(neighbours, "exact", lambda v, q: asked.append(len(v)) or exact(v, q))
    ids, score = block.search(-1, query, size, query / size @ neighbours.rotation(64).T, float(np.sort(want)[-200]), 20)
    assert ids.tolist() == best.tolist() and score.tolist() == want[best].tolist()
    assert sum(asked) < 60
