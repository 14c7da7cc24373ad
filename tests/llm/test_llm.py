"""The training-text operators on small cases, against brute force, round trips and held-out accuracy."""

import random
import re
import string
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import body, bodyfit, language, leak, lines, mojibake, packing, queries, truncation
from lodestone.sources import stores

# --- repeated lines ---


def test_site(spark):
    rows = [("https://WWW.Ab.Example:80/x", "ab.example"), ("http://u@n.b.test?q", "n.b.test"), ("nothing", None), (None, None), ("", None)]
    df = spark.createDataFrame(rows, "url string, want string").withColumn("got", lines.site_of(F.col("url")))
    assert all(r.got == r.want for r in df.collect())


def _brute_lines(rows, k=5):
    seen = defaultdict(set)
    key = lambda x: "".join(c for c in x.lower() if c.isalpha()).replace("ß", "ss")
    for _, url, text in rows:
        if url and text is not None:
            for x in text.split("\n"):
                if key(x):
                    seen[url.split("/")[2], key(x)].add(url)
    return {(i, n) for i, url, text in rows if url and text is not None for n, x in enumerate(text.split("\n"), 1) if key(x) and len(seen[url.split("/")[2], key(x)]) >= k}


def _line_rows(df):
    return lines.rows_of(df, F.col("row_id"), lines.site_of(F.col("url")), F.col("url"), F.col("text"))


def test_lines_in_deltas_equal_brute_force(spark, tmp_path):
    random.seed(1)
    pool = ["Share this!", "SHARE  this", "© 2025 Straße", "© 1999 STRASSE", "12 34", "", "rare"]
    rows = [(i, f"http://s{random.choice([0, 0, 0, 1])}.test/{random.randrange(12)}", "\n".join(random.choices([*pool, f"own {i}"], k=5))) for i in range(120)]
    rows += [(900, None, "Share this!"), (901, "http://s0.test/z", None), (902, "http://s0.test/z", ""), (903, "http://s0.test/z", "x" * 200_000)]
    df = spark.createDataFrame(rows, "row_id long, url string, text string").withColumn("key", F.lit("clash")).withColumn("doc", F.lit(1))
    part = lambda n: _line_rows(df.where(F.col("row_id") % 3 == n))
    state, earlier, crossed = lines.RepeatedLines(spark, f"{tmp_path}/state", 5), None, set()
    for n in range(3):
        state.advance(part(n), earlier)
        fresh = {r.key for r in state.counts.fresh().collect()}
        assert crossed.isdisjoint(fresh)
        crossed |= fresh
        earlier = part(n) if earlier is None else earlier.unionByName(part(n))
    assert {r.key for r in state.counts.crossed().collect()} == crossed
    got = [(r.row_id, r.line_no) for r in state.flagged.collect()]
    want = _brute_lines(rows)
    assert set(got) == want and len(got) == len(want) and want
    cleaned = [(r.row_id, r.cleaned) for r in state.cleaned.collect()]
    assert len(cleaned) == len(rows)
    for i, _, text in rows:
        assert dict(cleaned)[i] == (None if text is None else "\n".join(x for n, x in enumerate(text.split("\n"), 1) if (i, n) not in want))


def test_only_documents_with_newly_crossed_lines_are_rebuilt(spark, tmp_path):
    """Also by a session that opens the state another one left."""
    page = lambda i, *x: (i, f"http://a.test/{i}", "\n".join(x))
    own = lambda i: "own " + "abcdefghi"[i]
    first = [page(i, "often", own(i)) for i in range(6)] + [page(i, "soon", own(i)) for i in range(6, 9)] + [page(9, "own nine")]
    second = [page(20, "soon", "often"), page(21, "soon"), page(22, "own too")]
    make = lambda rows: _line_rows(spark.createDataFrame(rows, "row_id long, url string, text string"))
    one = lines.RepeatedLines(spark, f"{tmp_path}/state", 5).advance(make(first), None)
    two = lines.RepeatedLines(spark, f"{tmp_path}/state", 5)
    two.flagged, two.cleaned = one.flagged, one.cleaned
    two.advance(make(second), make(first))
    assert sorted(r.row_id for r in two.rebuilt.collect()) == [6, 7, 8, 20, 21, 22]
    assert {(r.row_id, r.line_no) for r in two.flagged.collect()} == {(i, 1) for i in [*range(9), 20, 21]} | {(20, 2)}
    assert {r.row_id: r.cleaned for r in two.cleaned.collect()} == {**{i: own(i) for i in range(9)}, 9: "own nine", 20: "", 21: "", 22: "own too"}
    with pytest.raises(stores.LostUpdate):
        two.counts.store.commit({}, on=1)


def test_lines_of_an_empty_table(spark, tmp_path):
    rows = _line_rows(spark.createDataFrame([], "row_id long, url string, text string"))
    state = lines.RepeatedLines(spark, f"{tmp_path}/state", 5).advance(rows, None).advance(rows, rows)
    assert state.flagged.count() == 0 and state.cleaned.count() == 0


# --- leaked passages ---


def test_leaks_against_brute_force(spark):
    random.seed(2)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(random.choices(vocabulary, k=random.choice([5, 9, 20, 60])))) for i in range(30)] + [(90, None), (91, ""), (92, "w1, W2")]
    docs = []
    for d in range(80):
        text = random.choices(vocabulary, k=random.randrange(0, 120))
        if d % 2:
            w = random.choice(items[:30])[1].split()
            a = random.randrange(len(w))
            text[len(text) // 2 : len(text) // 2] = [x.upper() for x in w[a : a + random.randrange(4, 20)]]
        docs.append((d, random.choice([" ", ", ", "\n", "_"]).join(text)))
    docs += [(100, None), (101, ""), (102, "  "), (103, docs[1][1]), (104, "x " * 200_000 + items[5][1])]

    def windows(t):
        w = leak.words_of(t or "")
        return {tuple(w[i : i + 9]) for i in range(len(w) - 8)}

    held = {i: windows(t) for i, t in items}
    want = {(d, i) for d, t in docs for i in held if windows(t) & held[i]}
    a, b = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0)), spark.createDataFrame(items, "item_id long, text string")
    grams = lambda t: {tuple(leak.words_of(t or "")[i : i + 5]) for i in range(len(leak.words_of(t or "")) - 4)}
    texts, item_texts = dict(docs), dict(items)
    shares = {(d, i): len(grams(item_texts[i]) & grams(texts[d])) / len(grams(item_texts[i])) for d, i in want}
    for got in (leak.leaks(a, b), leak.leaks(a, b, max_items=7)):
        assert {(r.doc_id, r.item_id): r.contained for r in got.collect()} == pytest.approx(shares) and want
    assert {(r.doc_id, r.item_id) for r in leak.leaks(a, b, share=0.5).collect()} == {k for k, v in shares.items() if v >= 0.5}
    assert leak.leaks(a.limit(0), b).count() == 0 and leak.leaks(a, b.limit(0)).count() == 0


# --- packing ---


@pytest.mark.parametrize("capacity", [1, 7, 64])
def test_packing(spark, capacity):
    random.seed(capacity)
    sizes = [(i, random.choice([0, 1, 3, 5, 8, 8, 8, 13, 150])) for i in range(300)] + [(7, 5), (400, None)]
    df = spark.createDataFrame(sizes, "doc_id long, size long")
    for limit in (10**6, 0):
        got = packing.pack(df, capacity, limit).collect()
        load, per = defaultdict(int), defaultdict(list)
        for r in got:
            load[r.container] += r["size"]
            per[r.doc_id].append(r["size"])
        assert max(load.values()) <= capacity
        want = defaultdict(int)
        for i, n in sizes:
            if n is not None:
                want[i] += n
        assert {i: sum(x) for i, x in per.items()} == want
        assert len(got) == sum(max(1, -(-n // capacity)) for _, n in sizes if n is not None)
    assert {r.container for r in got} == set(range(len(load)))
    pieces = sorted((min(n - i, capacity) for _, n in sizes if n for i in range(0, n, capacity)), reverse=True)
    bins: list[int] = []
    for s in pieces:  # plain best fit
        fits = [i for i, g in enumerate(bins) if g >= s]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= s
        else:
            bins.append(capacity - s)
    assert len([n for n in load.values() if n]) <= len(bins) * 1.02 + 1


def _rounds(histogram, capacity, first=None):
    """The same rounds without parts: one sweep over all runs."""
    documents, gaps, out, opened = [(s, n, 0) for s, n in histogram.items()], [], [], 0
    while documents:
        gaps = [g for g in gaps if g[0] >= min(s for s, _, _ in documents)]
        if not gaps:
            n = -(-sum(s * n for s, n, _ in documents) // capacity)
            gaps, opened = [(capacity, n, opened)], opened + n
        placed, made, documents, left = packing.swept(sorted([(s, 0, n, r) for s, n, r in documents] + [(g, 1, n, c) for g, n, c in gaps]), capacity // 8)
        out, gaps = out + placed, made + left
    return out, opened


def test_sweeps_over_parts(spark):
    rng = random.Random(37)
    for capacity in (16, 100):
        histogram = {s: rng.randint(1, 40) for s in range(1, capacity + 1) if rng.random() < 0.5}
        for parts in (1, 5):
            intervals, opened, rounds = packing.sweep(spark, histogram, capacity, parts)
            load, seen = defaultdict(int), defaultdict(set)
            for size, a, b, container, per in intervals:
                for r in range(a, b):
                    assert r not in seen[size]
                    seen[size].add(r)
                    load[container + (r - a) // per] += size
            assert {s: len(x) for s, x in seen.items()} == histogram and max(load.values()) <= capacity and set(load) == set(range(opened))
            assert opened <= _rounds(histogram, capacity)[1] * 1.05 + 1 and rounds < 60


def test_packing_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, size long"), 8).count() == 0


def test_sizes_equal_the_tokenizer(spark):
    texts = ["a  b", " x", "x ", "don't\tgo\n\n on", "l'été, 12,5 % – «oui»", "\xa0  x", "Привет мир", "word " * 3000, "\r\nx", "", "  \n", None]
    want = [(i, len(packing._encoding(packing.TOKENIZER).encode_ordinary(t))) for i, t in enumerate(texts) if t and t.strip()]
    got = packing.token_sizes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == want


# --- encodings ---

CLEAN = ["Für die Übergabe der Liste brauchte der Größere ungefähr fünf Sekunden.", "Según él, los títulos repetidos están aquí – después.", "Les équipes décrivent déjà la forêt où ça gèle.", "Język każdej strony został sprawdzony później.", "Посредники и их потоки доставляют порядок результатов."]
DAMAGE = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1250"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("iso8859-2", "latin-1")]


@pytest.fixture(scope="module")
def restorer():
    return mojibake.Restorer(*mojibake.counts_of(CLEAN * 50))


@pytest.mark.parametrize(("true", "read"), DAMAGE)
def test_restores_what_it_damaged(restorer, true, read):
    n = 0
    for text in CLEAN:
        try:
            bad = text.encode(true).decode(read)
        except UnicodeError:
            continue
        if bad == text:
            continue
        n += 1
        fixed, damaged = restorer.restore(bad)
        assert damaged, bad
        assert sum(a != b for a, b in zip(fixed.split(), text.split(), strict=True)) <= 2, fixed
    assert n


def test_clean_texts_and_examples_stay(restorer):
    for text in [*CLEAN, "", "plain ascii?", "He reports “Ã©” in feeds.", "see http://a.test/index.php?id=7&copy=1", "Is it? Yes.", "café · naïve – “x”", "a\xa0b"]:
        assert restorer.restore(text) == (text, 0)


def test_lost_bytes(restorer):
    assert restorer.restore("die gr��ere Liste, f�r uns") [1] == 2
    fixed, n = restorer.restore("T�tulos repetidos f�r uns")
    assert fixed == "Títulos repetidos für uns" and n == 2
    assert restorer.restore("f?r uns")[0] == "für uns"


def test_twice_and_entities(restorer):
    twice = "für".encode().decode("cp1252").encode().decode("cp1252")
    assert restorer.restore(twice)[0] == "für"
    assert restorer.restore("f&Atilde;&frac14;r uns")[0] == "für uns"


def test_restored_table(spark):
    rows = [(1, "a", "FÃ¼r uns fÃ¼r alle"), (2, "b", None), (3, "c", ""), (4, "d", "für")]
    df = spark.createDataFrame(rows, "id long, restored string, field string")
    counts = mojibake.frequencies(df.select("field").union(spark.createDataFrame([("für " * 50,)], "field string")))
    got = mojibake.restored(df, [F.col("id")], F.col("field"), counts).collect()
    assert [(r.id, r.restored, r.damaged) for r in got] == [(1, "Für uns für alle", 2)]
    assert mojibake.restored(df.limit(0), [F.col("id")], F.col("field"), counts).count() == 0


def test_words_beyond_those_held_restore_too(spark):
    rows = [(i, text) for i, text in enumerate(CLEAN * 3)]
    rows += [(100 + 10 * i + j, text.encode(true, "ignore").decode(read, "ignore")) for i, text in enumerate(CLEAN) for j, (true, read) in enumerate(DAMAGE)]
    rows += [(900, "die gr\ufffd\ufffdere Liste, f\ufffdr uns"), (901, "f?r uns"), (902, None), (903, "")]
    df = spark.createDataFrame(rows, "id long, field string")
    found = lambda n: {r.id: (r.restored, r.damaged) for r in mojibake.restored(df, [F.col("id")], F.col("field"), mojibake.frequencies(df.select("field"), n)).collect()}
    every = found(100_000)
    assert found(3) == every and len(every) > 20


# --- main body ---


def test_best_region_against_brute_force():
    random.seed(4)
    for _ in range(300):
        s = [random.randint(-5, 5) for _ in range(random.randint(0, 9))]
        a, b = body.best_region(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])


def site_pages(rng, n=60, site=0):
    """Pages of a site of our own making, with the label of each line: a heading and byline, paragraphs, a list, furniture between and around."""
    word = lambda: "".join(rng.choices("aeioulmnrst", k=rng.randint(4, 9)))
    sentence = lambda: (" ".join(word() for _ in range(14))).capitalize() + "."
    name = lambda: "".join(rng.choices("bdfgkpvz", k=2)).capitalize() + word()
    title = lambda: f"{word()} {word()} {word()} – {name()}".capitalize()
    out = []
    for i in range(n):
        t = title()
        lines = [(False, "Bakery"), (False, "Opening hours"), (False, "Bakery › Bread › Rolls"), (True, t), (True, f"Written for the bakery by {name()} {name()}")]
        for j in range(rng.randint(2, 4)):
            lines.append((True, f"{sentence()} {sentence()}"))
            if j == 0:
                lines += [(True, f"- {word()} {word()} {word()}") for _ in range(2)] + [(False, "Fresh rolls at your door: order before noon.")] * rng.randint(0, 1)
        lines += [(False, "Other pages of the bakery"), *[(False, f"- {title()}") for _ in range(3)], (False, f"{rng.randint(1, 900)} guests liked this"), (False, f"© {rng.randint(1990, 2025)} The bakers")]
        out.append((f"http://bakery{i % 6}.test/{site}/{i}", t if i % 7 else None, lines))
    return out


def test_held_out_furniture():
    """Weights from labels that pages give each other, tested on other pages of other names."""
    rng = random.Random(23)
    fit, held = site_pages(rng), site_pages(rng, 40, 1)
    w = body.fitted([(u, t, "\n".join(x for _, x in lines)) for u, t, lines in fit], [])
    right = wrong = 0
    for _, _, lines in held:
        for (want, _), got in zip(lines, body.body_lines("\n".join(x for _, x in lines), w), strict=True):
            right, wrong = right + (want == got), wrong + (want != got)
    assert right / (right + wrong) >= 0.95


def test_furniture_of_a_page(spark):
    rng = random.Random(29)
    w = body.fitted([(u, t, "\n".join(x for _, x in lines)) for u, t, lines in site_pages(rng)], [])
    lines = site_pages(rng, 1, 2)[0][2]
    page = "\n".join(x for _, x in lines) + "\n\n"
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "\n\n"), (5, "word " * 200_000), (6, page)], "i long, text string").withColumn("row_id", F.lit(0))
    got = defaultdict(list)
    for r in body.furniture(df, F.col("i"), F.col("text"), w).collect():
        got[r.row_id].append(r.line_no)
    assert sorted(got[1]) == sorted(got[6]) == [n for n, (is_body, _) in enumerate(lines, 1) if not is_body]
    assert set(got) <= {1, 5, 6}
    bodies = {r.row_id: r.body for r in body.main_body(df, F.col("i"), F.col("text"), w).collect()}
    assert bodies[1] == "\n".join(x for is_body, x in lines if is_body)
    assert bodies[2] is None and bodies[3] == ""


def test_nothing_to_learn_from(spark):
    w = body.fitted([], [])
    assert body.body_lines("Menu\n\nSome text.", w) == [True, None, True]
    empty = spark.createDataFrame([], "url string, title string, text string")
    assert body.sample_of(empty, "url", "title", "text") == [] and body.furniture(empty.withColumn("i", F.lit(1)), F.col("i"), F.col("text"), w).count() == 0


def test_many_lines_at_once_are_taken_apart_as_each_by_itself(monkeypatch):
    """A token is taken apart once however often it stands, and lines at once get the words, hashes and weights of lines by themselves."""
    rng, signs = random.Random(4), "abx ΣςσΑ'’,;.!?()-_»”\")]  \t\xa0\u3000\x1f 019²①٣•*–›|/:…©éİ"
    lines = ["".join(rng.choices(signs, k=rng.randrange(25))) for _ in range(3000)] + ["one two, ² three", "one two, ² 3"] * 2
    plain = [["0" if w.isdigit() and re.search(r"\d", x) else w for w in re.findall(r"[^\W\d_]+|\d+", x.lower())] for x in lines]
    at, word, words = body.worded(lines)
    got = [[] for _ in lines]
    for i, w in zip(at.tolist(), word.tolist(), strict=True):
        got[i].append(words[w])
    assert got == plain == [body._words(x) for x in lines]
    for x in lines:
        assert body._shape(x) == re.sub(r"\s+", " ", re.sub(r"[^\W_]+(?:[ '’,;.!?()\-]+[^\W_]+)*", "x", x.strip()))
        assert body.ends_sentence(x) == (re.search(r"[.!?…][\"'”»)\]]*\s*$", x) is not None)
        s = x.strip().replace("\xa0", " ")
        s = s[m.end() :] if (m := re.match(r"^\s*(?:([-*•–])|(\d+)[.)])\s", s)) else s
        assert {t for kind, t, _ in body._tags(x, 1) if kind == "tag"} == {" " if t.isspace() else t for t in re.findall(r"[›»|·←→©•/–…:]|\s\s+(?=\S)", s)}
    known = frozenset(["a", "b", "ab", "0", "x"])
    by_itself, at_once = (body.Weights({"a": 1.5, "0": -2.0, ("tag", "›", ""): -1.0, ("bullet", "*", ""): 0.5}, 0.25, known, frozenset([("a", "xxx"), ("b",), ("0", "x")])) for _ in range(2))
    hashes = body.skeletons(at, word, words, known, len(lines)).tolist()
    of: dict = {}
    for x, k in zip(lines, hashes, strict=True):
        skeleton = by_itself.skeleton(body._words(x))
        assert (k == 0) == (not any(w not in ("xxx", "0") for w in skeleton)) and (k == 0 or of.setdefault(k, skeleton) == skeleton)
    assert len(of) == len(set(of.values()))
    at_once.look(["\n".join(lines)])
    calls: list = []
    monkeypatch.setattr(body, "_tags", lambda *a: calls.append(a) or [])
    told = [at_once.line(x) for x in lines if x.strip()]
    assert not calls
    monkeypatch.undo()
    want = [by_itself.line(x) for x in lines if x.strip()]
    assert [b for _, b in told] == [b for _, b in want] and all(abs(a - b) < 1e-9 for (a, _), (b, _) in zip(told, want, strict=True))


def test_counts_of_tokens_at_once(monkeypatch):
    """However many texts are counted at once, and whatever blanks stand between words."""
    texts = ["été Été\tgröße\nété", None, "", "plain words", "жук\x1fжук\xa0жук  é", "�x «été»"] * 7
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["field"])
    words, chars = mojibake.Counter(), mojibake.Counter()
    mojibake._spread(mojibake.Counter(t for x in texts if x for t in x.split(" ") if not t.isascii()), words, chars)
    want = {(w, n, True) for w, n in words.items()} | {(c, n, False) for c, n in chars.items()}
    for rows in (1, 4, 1_000):
        monkeypatch.setattr(mojibake, "_ROWS", rows)
        got = [tuple(r.values()) for b in mojibake._counts(iter([batch])) for r in b.to_pylist()]
        assert len(got) == len(want) and set(got) == want


def test_readings_without_channels_that_change_nothing():
    r = mojibake.Restorer({"größe": 5, "été": 9}, {"ö": 5, "ß": 5, "é": 18})
    rng, alone = random.Random(3), 0
    for _ in range(5000):
        token = "".join(rng.choices("aéöß€\x80Ã©жñ\xa0&;", k=rng.randrange(1, 6)))
        if r._stand_alone(token):
            alone += 1
            assert all(c.read(token) == token for c in r.channels if c.strict)
    assert alone > 500


def test_weights_of_all_pages_of_a_table(spark):
    """With one shard they are those of the pages at hand; with more, bodies are the same."""
    rows = [(u, t, "\n".join(x for _, x in lines)) for u, t, lines in site_pages(random.Random(29))]
    clean = ["One clean sentence stands here.", "And here another one, as clean."]
    df = spark.createDataFrame([*rows, ("u", None, None), (None, None, " \n ")], "u string, t string, x string").repartition(5)
    got, want = bodyfit.fitted([df.where("length(x) % 2 = 0 or x is null"), df.where("length(x) % 2 = 1")], clean), body.fitted(rows, clean)
    assert (got.known, got.openers) == (want.known, want.openers) and got.weights.keys() == want.weights.keys()
    for _, _, text in rows:
        assert body.body_lines(text, got) == body.body_lines(text, want)
    shards = bodyfit.fitted([df], clean, len(rows) // 2)
    assert (shards.known, shards.openers) == (want.known, want.openers)
    lines = [(a, b) for _, _, x in rows for a, b in zip(body.body_lines(x, shards), body.body_lines(x, want), strict=True)]
    assert sum(a == b for a, b in lines) > 0.99 * len(lines)
    assert body.body_lines("a\nb", bodyfit.fitted([df.where("false")], [])) == [True, True]


def test_no_page_is_left_out_of_the_weights(spark, tmp_path):
    """Each of the rare words stands on three of 6,000 pages, each of another site; one of them is a very long page."""
    rare = ["rare" + a + b for a in "abcdef" for b in "vwxyz"]
    word = lambda i: rare[i % 2000] if i % 2000 < len(rare) else "more"
    rows = [(f"https://s{i % 9}.example/{i}", "t", f"Some words of page {i} and {word(i)} too." + " long" * (30_000 * (i == 0))) for i in range(6000)]
    spark.createDataFrame(rows, "canonical_url string, title string, text string").write.parquet(str(tmp_path / "pages_text.parquet"))
    spark.createDataFrame(rows[:3], "url string, title string, content string").write.parquet(str(tmp_path / "search_documents.parquet"))
    spark.createDataFrame([("A clean sentence.",)], "text string").write.parquet(str(tmp_path / "lang_samples.parquet"))
    assert set(rare) <= queries._weights(spark, str(tmp_path)).known


# --- languages ---

WORDS = {"en": "the of and with under some many peers share pages before every hour", "de": "der die und mit unter einige viele teilen seiten vor jeder stunde nicht", "ru": "и под некоторые многие делят страницы перед каждым часом не только они"}


def sentence(rng, lang, n=9):
    w = rng.choices(WORDS[lang].split(), k=n)
    return " ".join(w).capitalize() + "."


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(3)
    return [(lang, sentence(rng, lang)) for lang in WORDS for _ in range(20)]


def test_held_out_accuracy(samples):
    rng, model, right = random.Random(9), language.Model(samples), 0
    tests = [(lang, sentence(rng, lang)) for lang in WORDS for _ in range(50)]
    for (lang, _), r in zip(tests, model.label([t for _, t in tests]), strict=True):
        right += [model.langs[i] for i in model.languages(*r)] == [lang]
    assert right / len(tests) >= 0.95


def test_viterbi_equals_brute_force(samples):
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    score = rng.normal(0, 12, (7, 3))
    path = language.Model._viterbi(score, [0, 1, 2])
    value = lambda p: sum(score[i, s] for i, s in enumerate(p)) - language.SWITCH * sum(a != b for a, b in zip(p, p[1:], strict=False))
    assert abs(value(path) - max(value(p) for p in itertools.product(range(3), repeat=7))) < 1e-9


def test_labels_equal_the_full_search(samples):
    """Also where the best path never touches the language that is best throughout: 16 - 2 - 2 beats 3 x 4 at no point alone."""
    import numpy as np

    model = language.Model([("aa", "a"), ("bb", "b"), ("cc", "c")])
    rng = np.random.default_rng(5)
    cases = [np.array([[-1.0, 0, -2]] * 13 + [[-1.0, -2, 0]] * 13)]
    cases += [np.repeat(rng.normal(0, 1.2, (4, 3)), rng.integers(3, 20), axis=0) for _ in range(200)]
    searched = 0
    for score in cases:
        model.table = np.vstack([np.zeros((1, 3)), score]).astype(np.float32)
        model.rows = list(model.table)
        model.tokens = lambda t, n=len(score): [2 * (i + 1) for i in range(n)]
        (_, path, sums) = model.label(["x"])[0]
        value = lambda p: sum(model.table[i + 1, s] for i, s in enumerate(p)) - language.SWITCH * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = language.Model._viterbi(model.table[1:], [0, 1, 2])
        assert abs(value(path or [int(sums.argmax())] * len(score)) - value(best)) < 1e-3
        searched += path is not None
    assert model.label(["x"]) and searched > 3 and len(set(language.Model._viterbi(cases[0], [0, 1, 2]))) == 2


def test_scripts():
    model = language.Model([("el", "και το σπίτι είναι μεγάλο."), ("he", "הבית הזה גדול מאוד."), ("ru", "этот дом очень большой."), ("en", "this house is very large.")])
    texts = ["μικρό δέντρο κοντά στη θάλασσα", "ספר קטן על השולחן", "маленькая книга на столе", "small trees beside lakes", "本は机の上にある", "x" * 50_000]
    got = [[model.langs[i] for i in model.languages(*r)] for r in model.label(texts)]
    assert got[:5] == [["el"], ["he"], ["ru"], ["en"], []]


def test_mixed_texts_quotes_and_nulls(spark, samples):
    rng = random.Random(5)
    s = lambda lang, n: " ".join(sentence(rng, lang) for _ in range(n))
    texts = {1: s("en", 4) + "\n" + s("de", 3), 2: s("en", 4) + " Some said “" + s("de", 1) + "” then. " + s("en", 1), 3: None, 4: "  ", 5: "Qvxz Wqrt", 6: s("ru", 2) + " " + s("en", 1) + " " + s("ru", 2), 7: s("de", 1), 8: s("en", 5000), 9: s("en", 2) + "\nhttp://der.die.und/seiten\n2025-01-01 seiten=3 stunde=2"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string").withColumn("langs", F.lit(1))
    model = language.Model(samples)
    got = {r.id: r.langs for r in language.languages(df, [F.col("id")], F.col("text"), model).collect()}
    assert got == {1: ["de", "en"], 2: ["en"], 3: [], 4: [], 5: [], 6: ["ru"], 7: ["de"], 8: ["en"], 9: ["en"]}
    spans = defaultdict(list)
    for r in language.segments(df, [F.col("id")], F.col("text"), model).collect():
        spans[r.id].append((r.segment, r.start, r.end, r.lang, r.confidence))
    assert [x[3] for x in sorted(spans[1])] == ["en", "de"]
    assert sorted(spans[1])[0][1] == 0 and sorted(spans[1])[-1][2] == len(texts[1]) and all(0.5 <= x[4] <= 1 for x in spans[1])
    cut = sorted(spans[1])[1][1]
    assert abs(cut - texts[1].index("\n")) < 12
    assert 3 not in spans and 4 not in spans


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in (" EN ", "pt_BR", "de-AT-x", "eng", "e", "", None, "x-en")], "l string")
    assert [r[0] for r in df.select(language.label_language(F.col("l"))).collect()] == ["en", "pt", "de", None, None, None, None, None]


def _tables(spark, folder, **tables):
    """Small tables of the columns that the queries of this package read, written to a folder."""
    shapes = {
        "lang_samples": "sample_id long, lang string, text string", "documents": "doc_id long, lang string, source string, text string", "pages_text": "stream_seq long, language string, text string, canonical_url string, title string",
        "search_documents": "stream_seq long, language string, content string, url string, title string", "url_metadata": "stream_seq long, lang string, descr string, snippet string",
    }
    for name, shape in shapes.items():
        rows = [(*r, *[None] * (shape.count(",") + 1 - len(r))) for r in tables.get(name, [])]
        spark.createDataFrame(rows, shape).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _sample_rows(samples):
    return [(i, lang, text) for i, (lang, text) in enumerate(samples)]


def test_garbled_text_with_a_language_of_its_own_is_repaired(spark, samples, tmp_path):
    rng = random.Random(7)
    text = " ".join(sentence(rng, "ru") for _ in range(6))
    bad = text.encode("cp1251").decode("cp1252")
    model = language.Model(samples)
    mixed = " ".join(sentence(rng, "en") for _ in range(3)) + " " + bad
    assert model.languages(*model.label([mixed])[0]) == [model.langs.index("en")]  # what is clean says something
    folder = _tables(spark, tmp_path, lang_samples=_sample_rows(samples), documents=[(1, "en", "s", mixed), (2, "en", "s", None), (3, "en", "s", sentence(rng, "en"))])
    got = {(r.tab, r.rec_id, r.lang_code) for r in queries.p1_found(spark, folder).collect()}
    assert got == {("documents", 1, "en"), ("documents", 1, "ru")}


def test_segments_stand_in_the_stored_text(spark, samples, tmp_path):
    rng = random.Random(11)
    title = " ".join(sentence(rng, "ru") for _ in range(2))
    garbled = title.encode("cp1251").decode("cp1252")
    plain = " ".join(sentence(rng, "en") for _ in range(4))
    pages = [(10 + i, None, "\n".join(x for _, x in lines), u, t) for i, (u, t, lines) in enumerate(site_pages(rng))]
    page = "Bakery › Bread › Rolls\n" + plain + "\n© 2025 The bakers"
    twice = sentence(rng, "ru").encode().decode("koi8-r")  # two characters for each letter
    folder = _tables(spark, tmp_path, lang_samples=_sample_rows(samples), pages_text=[(1, "en", page), *pages], search_documents=[(1, "ru", garbled)], documents=[(1, "ru", "s", twice + " " + plain)])
    got = defaultdict(list)
    for r in queries.p1_segments(spark, folder).where("rec_id = 1").orderBy("segment").collect():
        got[r.tab].append((r.start, r.end, r.lang))
    assert got["pages_text"] == [(page.index(plain), page.index(plain) + len(plain), "en")]
    assert got["search_documents"] == [(0, len(garbled), "ru")]
    assert [x[2] for x in got["documents"]] == ["ru", "en"] and got["documents"][0][0] == 0 and got["documents"][1][1] == len(twice + " " + plain)
    assert abs(got["documents"][1][0] - len(twice)) <= 1 and got["documents"][0][1] == got["documents"][1][0]


def test_bodies_agree_with_furniture_on_garbled_pages(spark, samples, tmp_path):
    rng = random.Random(31)
    pages = [(10 + i, None, "\n".join(x for _, x in lines), u, t) for i, (u, t, lines) in enumerate(site_pages(rng))]
    clean = "Größere Übergabe für die Prüfung läuft über das Gerät, während später größere Aufträge für später übrig bleiben."
    text = ("Bakery › Bread › Rolls\n" + clean).encode().decode("cp1252", "ignore")
    folder = _tables(spark, tmp_path, lang_samples=[*_sample_rows(samples), (900, "de", clean)], search_documents=[(1, "de", text), (2, "de", None), *pages])
    out = defaultdict(set)
    for r in queries.p4_found(spark, folder).collect():
        out[r.stream_seq].add(r.line_no)
    bodies = {r.stream_seq: r.body for r in queries.p4_bodies(spark, folder).collect()}
    assert out[1] == {1} and bodies[1] == clean and bodies[2] is None
    for i, _, x, *_ in pages:
        assert bodies[i] == "\n".join(line for n, line in enumerate(x.split("\n"), 1) if n not in out[i])


def test_repair_before_labels_knows_the_words_of_all_texts(spark, tmp_path, samples):
    rng = random.Random(13)
    words = ["".join(rng.choices("абвгдежзиклмнопрстуфхцчшщыэюя", k=9)) for _ in range(30)]  # in no sample
    text = " ".join(words).capitalize() + "."
    folder = _tables(spark, tmp_path, lang_samples=_sample_rows(samples), search_documents=[(i, "ru", text) for i in range(5)] + [(9, "ru", text.encode("koi8-r").decode("cp1252"))])
    assert [r.stream_seq for r in queries.p3_found(spark, folder).collect()] == [9]
    assert {(r.start, r.end, r.lang) for r in queries.p1_segments(spark, folder).where("rec_id = 9").collect()} <= {(0, len(text), "ru")}
    got = queries._page_lines(spark, folder)[1][1][1].where("stream_seq = 9").first().content
    assert got == text


# --- truncation ---


@pytest.mark.parametrize(
    ("text", "verdict"),
    [
        ("All is said.", "complete"), ("Is it (“Name”).", "complete"), ("All is sai", "cut"), ("All is said, and", "cut"), ("Done. …", "complete"), ("The end of it …", "ask"), ("The end of i…", "cut"), ("The end of i...", "cut"), ("Bytes los�", "cut"),
        ("Text.\n— Anna Bert", "form"), ("Text.\n— Ann", "cut"), ("x.\nhttps://a.example/b/1", "form"), ("x.\nhttps://a", "cut"), ("- Anna: the whole ring", "ask"), ("x.\nctl sweep --ring 3 --host a.test", "form"), ("x.\nctl sweep --ring 3 --ho", "cut"),
        ("", "complete"), (" \n", "complete"), ("…", "cut"), ("x. " * 100_000, "complete"),
    ],
)
def test_endings(text, verdict):
    assert truncation.ending(text)[0] == verdict


def test_truncated_source(spark):
    random.seed(8)
    word = lambda: "".join(random.choices(string.ascii_lowercase, k=random.randint(2, 7)))
    rows, cut = [], set()
    for i in range(400):
        text = ". ".join(" ".join(word() for _ in range(6)) for _ in range(random.randint(4, 30))) + "."
        source = random.choice(["a", "b", None])
        if source == "a" and len(text) > 500:
            text = text[:500]
            if text.rstrip()[-1] != ".":
                cut.add(i)
        rows.append((i, source, text))
    rows += [(900, "a", None), (901, "b", " "), (902, "b", rows[0][2]), (903, "b", rows[0][2])]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n", F.lit(1))
    found, hazards = truncation.truncated(df)
    assert {r.doc_id for r in found.where("cut").collect()} == cut and cut
    assert {r.evidence for r in found.where("cut and at_limit").collect()} == {truncation.LIMIT} and found.where("not cut and evidence is not null").count() == 0
    assert {(r.source, r.unit, r.length) for r in hazards.where("limit").collect()} >= {("a", "chars", 500), ("a", "bytes", 500)}
    assert not {r.source for r in hazards.where("limit").collect()} - {"a"}
    assert truncation.truncated(df.limit(0))[0].count() == 0


def test_copies_and_limits_of_endings_in_doubt(spark):
    rng = random.Random(17)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 7)))
    rows = [(i, "b", "All of it stood. Then the whole ring, and more.") for i in range(5)]  # copies: their clauses count once
    rows.append((10, "b", "Some of it stood.\n- Anna: the whole ring"))
    rows += [(20 + i, "c", f"The {word()} {word()} blue lamp, and {word()}.") for i in range(3)]
    head = "- Anna: the blue lamp"
    for i in range(400):
        text = ". ".join(" ".join(word() for _ in range(6)) for _ in range(rng.randint(4, 30))) + "."
        rows.append((100 + i, "a", text[:499] + "." if len(text) > 500 else text))
    filler = ". ".join(" ".join(word() for _ in range(6)) for _ in range(30))
    rows.append((50, "a", filler[: 500 - len(head) - 2] + ".\n" + head))
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found, hazards = truncation.truncated(df)
    cut = {r.doc_id for r in found.where("cut").collect()}
    assert ("a", "chars", 500) in {(r.source, r.unit, r.length) for r in hazards.where("limit").collect()}
    assert 10 in cut and 50 in cut


def test_clauses_are_judged_by_a_rate(spark):
    """Two words that end a clause now and then can't end a text, however large the corpus; held or counted by a shuffle alike."""
    rows = [(i, "s", f"Here number {i} the blue lamp stood alone. And the old boat, it is told, left number {i}.") for i in range(60)]
    rows += [(100 + i, "s", f"There {i} was the blue lamp." + " Then more." * (9 * i + 9)) for i in range(3)]
    rows += [(200, "s", "All of it is said.\n- Anna: the blue lamp"), (201, "s", "All of it is said.\n- Anna: the old boat"), (202, "s", "All of it is said [" + "and so on " * 20 + "]"), (203, "s", "It stopped in the mid [" + "cut " * 30 + "]")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    texts = truncation.endings(df)
    counts = {r.words: (r.ends, r.n) for r in truncation.clause_ends(df, texts).collect()}
    assert counts["blue lamp"] == (3, 63) and counts["old boat"] == (60, 60)
    assert {r.words: (r.ends, r.n) for r in truncation.clause_ends(df, texts, max_held=0).collect()} == counts
    assert {r.doc_id for r in truncation.truncated(df)[0].where("cut").collect()} & {200, 201, 202, 203} == {200, 203}


def test_sources_show_limits_in_bytes(spark, tmp_path):
    rng, rows = random.Random(19), []
    word = lambda: "".join(rng.choices("abcdeföüß", k=rng.randint(2, 7)))
    for i in range(400):
        text = ". ".join(" ".join(word() for _ in range(6)) for _ in range(rng.randint(4, 30))) + "."
        rows.append((i, "de", "a", text.encode()[:600].decode("utf-8", "ignore").ljust(1)))
    rows = [(i, lang, s, x + "x" * (600 - len(x.encode())) if 597 < len(x.encode()) < 600 else x) for i, lang, s, x in rows]
    folder = _tables(spark, tmp_path, documents=rows)
    got = queries.p8_sources(spark, folder).first()
    assert 600 in got.limits_bytes and 600 not in got.limits



# --- many texts at once ---


def test_labels_of_many_texts_are_those_of_each_by_itself(samples):
    """Each distinct token is looked up once in a chunk, and texts at once get the tokens and labels that they get alone."""
    rng, words = random.Random(6), [w for _, t in samples for w in t.split()] + ["\xa0", "　x", "a\x1fb", "12.", "Zu", "…»"]
    texts = ["", "\n", " \n\n x "] + ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", "\xa0", "\x1f", "\r\n"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    model, plain = language.Model(samples), language.Model(samples)
    made = []
    for t in texts:
        ids = []
        for line in t.split("\n"):
            ids += [*map(plain._id_of, line.split()), 1]
        made.append(ids)
    assert [x.tolist() for x in model._tokens(texts)] == made == [model.tokens(t).tolist() for t in texts]
    alone = [model.label([t])[0] for t in texts]
    for (ids, path, sums), (ids1, path1, sums1), ids2 in zip(model.label(texts), alone, made, strict=True):
        assert ids.tolist() == ids1.tolist() == ids2 and path == path1 and sums.tolist() == sums1.tolist()
    calls: list = []
    model.cache, model._id_of = {}, lambda t: calls.append(t) or 2
    model.label(["one one one\none", "one two"])
    assert calls == ["one", "two"]


def test_damage_of_many_texts_is_that_of_each_by_itself():
    rng, held = random.Random(8), mojibake.counts_of(CLEAN * 50)
    tokens = [w for t in CLEAN for w in t.split()]
    hurt = [w.encode().decode("cp1252", "ignore") for w in tokens] + [re.sub(r"[^\x00-\x7f]", "�", w) for w in tokens] + ["a?b", "x&amp;y", "&", "?", "\r", "é\r", "“�”"]
    texts = ["", None] + ["".join(rng.choice(tokens if rng.random() < 0.9 else hurt) + rng.choice([" ", " ", "\n", "\t ", "\x0b"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    at_once, alone = mojibake.Restorer(*held), mojibake.Restorer(*held)
    got = at_once.damages(texts, [None] * len(texts))
    assert got == [alone.damage(t) if t else [] for t in texts] and 50 < sum(map(bool, got)) < 300


def test_tasks_of_a_worker_share_a_restorer(spark):
    """Of the same counts a worker makes one, so that its next task doesn't read the same tokens again; it holds a few."""
    held = mojibake.counts_of(CLEAN)
    first, again = (mojibake.restorers(spark, mojibake.Counts(*held, 9)) for _ in range(2))
    assert first() is first() is again()
    others = [mojibake.restorers(spark, mojibake.Counts(*held, n))() for n in (10, 11, 12)]
    assert others[0] is not others[1] and len(mojibake._RESTORER_OF) == mojibake._RESTORERS


def test_a_token_is_taken_apart_once(monkeypatch):
    v, found = body.Vocabulary(), []
    monkeypatch.setattr(body, "_WORD", type("", (), {"findall": staticmethod(lambda t: found.append(t) or [t.strip(".")])}))
    assert v.taken(["one. two", "One. one."])[1].tolist() == v.taken(["one. two one. one."])[1].tolist()
    assert found == ["one.", "one."] and list(v.numbers) == ["0", "one", "two"]
