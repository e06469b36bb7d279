"""Null, empty and very long texts, ties, repeated rows, empty tables and clashing names for every operator and stage."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from phenospark.llm import chat, decontaminate, jaccard, langid, neighbours, packing, pages, secrets, substrings, toxicity
from phenospark.llm import common as C

#: Documents with columns whose names the operators use inside, too.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, node long, tokens string, key string, id string, slot int, score double, spans string, __slot int, h long"
rng = random.Random(11)
LONG = " ".join(f"w{rng.randrange(900)}" for _ in range(60_000))


def texts():
    near = [" ".join(f"v{rng.randrange(400)}" for _ in range(80)) for _ in range(4)]
    return [None, "", " \n\t", "one", LONG, LONG + " end", *near, near[0], near[0] + " more", "ÄÖ 中文 é", "x" * 50_000]


TEXTS = texts()


def clash(spark, said=TEXTS, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", len(t or ""), None, "x", "k", "i", 1, 0.5, "sp", 2, 3) for i, t in enumerate(said)]
    return spark.createDataFrame(rows, CLASH)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id long, hits int")


ITEM = " ".join(LONG.split()[100:130])


def operators(spark, docs):
    """The result of every operator over documents, as sorted tuples."""
    lexicon = toxicity.Lexicon({"idiot": (0.9, False)})
    model = langid.train([(*langid.features(t), y) for t, y in (("the of and", "en"), ("der die und", "de")) * 5])
    benchmark = bench(spark, [(1, ITEM, 0, 0), (2, None, 0, 0), (3, "", 0, 0)])
    parts = C.materialize(packing.pieces(docs, packing.default_tokenizer()))
    return {
        "toxicity": toxicity.digest(toxicity.score(docs, lexicon)),
        "jaccard": jaccard.digest(jaccard.components(docs, shingle=3, percent=90)),
        "secrets": secrets.digest(secrets.find(docs)),
        "substrings": substrings.digest(substrings.dedup(docs)),
        "decontaminate": decontaminate.digest(decontaminate.find(docs, benchmark)),
        "packing": packing.pack(parts).select("doc_id", "piece", "start", "length", "ids_crc32"),
        "language": langid.digest(langid.predict(docs, model)),
    }


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents_with_clashing_names(spark):
    """Extra columns change nothing, and every row has its result."""
    plain = operators(spark, clash(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    for name, df in operators(spark, clash(spark)).items():
        got = rows(df)
        assert got == rows(plain[name]), name
        assert {r[0] for r in got} == set(range(len(TEXTS))), name
    told = {r.doc_id: r for r in plain["substrings"].collect()}
    assert (told[5].n_words, told[5].n_removed, told[10].n_removed) == (60_001, 60_000, 80)
    hit = {r.doc_id: r for r in plain["decontaminate"].collect()}
    assert hit[4].n_hit >= 30 and hit[4].n_items == 1 and not hit[0].contaminated
    comp = {r.doc_id: r.component_id for r in plain["jaccard"].collect()}
    assert (comp[5], comp[10], comp[11], comp[0], comp[1]) == (4, 6, 6, 0, 1)


def test_empty_tables(spark):
    for name, df in operators(spark, clash(spark).limit(0)).items():
        assert df.count() == 0, name
    none = clash(spark).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(none, labels).terms == {} and langid.fit(none).predict("text") == ("und", 0.0)
    assert decontaminate.digest(decontaminate.find(clash(spark), bench(spark, []))).where("contaminated").count() == 0
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string, key int")).count() == 0
    assert chat.digest(chat.format_rows(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))).count() == 0
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<double>, vector int"), F.lit(True)).count() == 0
    assert jaccard.keep_one(none).count() == secrets.clean(none).count() == 0


def test_repeated_rows_and_null_ids(spark):
    """Rows under one id, and rows without one, each have a result; copies of one id are no copies of each other."""
    ids = [7, 7, 7, 7, 3, 3, 9, 9, 8, 5, 9, 9, None, None]
    for name, df in operators(spark, clash(spark, ids=ids)).items():
        got = Counter(r[0] for r in df.collect())
        if name != "packing":
            assert got == Counter(ids), name
        assert set(got) == set(ids), name
    twice = clash(spark).unionByName(clash(spark))
    both = {n: rows(df) for n, df in operators(spark, twice).items()}
    for name, df in operators(spark, clash(spark)).items():
        assert both[name] == sorted(rows(df) * 2, key=str), name
    said = [LONG, "a b c d e", "a b c d e f g h", LONG + " z"]
    comp = jaccard.components(clash(spark, said, [4, 4, 6, 9]), shingle=3, percent=90).collect()
    assert sorted((r.doc_id, r.component_id) for r in comp) == [(4, 4), (4, 4), (6, 6), (9, 4)] or sorted((r.doc_id, r.component_id) for r in comp) == [(4, 4), (4, 4), (6, 6), (9, 9)]


def test_conversations(spark):
    schema = "conv_id long, turn int, role string, text string, record string, ms int, turns int, formatted string"
    data = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, None, None), (None, 0, "assistant", "a"), (2, None, "assistant", "x" * 100_000)]
    frame = spark.createDataFrame([(*r, "r", 1, 2, "f") for r in data], schema)
    got = {r.conv_id: r for r in chat.digest(chat.format_rows(frame)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[None].n_turns, got[2].loss_chars) == (3, 0, 1, 100_000)
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nq\nuser\nq\n\n\n").hexdigest()


LAYOUTS = [
    ('{"messages":[{"role":"user","content":"a"},{"role":"gpt","content":"b"}]}', [("user", "a"), ("assistant", "b")]),
    ('{"system":"s","messages":[{"role":"human","content":null}]}', [("system", "s"), ("user", "")]),
    ('{"conversations":[{"from":"human","value":"a"},{"from":"bot","value":"b"}]}', [("user", "a"), ("assistant", "b")]),
    ('{"prompt":"p","completion":"c"}', [("user", "p"), ("assistant", "c")]),
    ('{"prompt":"p","response":"c"}', [("user", "p"), ("assistant", "c")]),
    ('{"instruction":"i","output":"o"}', [("user", "i"), ("assistant", "o")]),
    ('{"instruction":"i","input":"","output":"o"}', [("user", "i"), ("assistant", "o")]),
    ('{"instruction":"i","input":"n","output":"o","system":"s"}', [("system", "s"), ("user", "i\nn"), ("assistant", "o")]),
    ('{"question":"q","answer":"a"}', [("user", "q"), ("assistant", "a")]),
    ('{"unheard":{"of":1}}', None),
    (None, None),
]


def test_layouts(spark):
    """Every layout against its turns, written and read back."""
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LAYOUTS)], "i int, r string")
    done = chat.render(chat.canonical(frame, "r"))
    got = {x.i: x for x in done.select("i", "fingerprint", chat.read_back(F.col("formatted")).alias("back"), chat.masked(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    for i, (_, want) in enumerate(LAYOUTS):
        assert (None if got[i].back is None else [tuple(t) for t in got[i].back]) == want
        if want:
            assert got[i].loss == "".join(t for r, t in want if r == "assistant")
    known = [got[i].fingerprint for i in (0, 1, 2, 3, 4, 5, 6, 7, 8)]
    assert len(set(known)) == 9


def test_vectors(spark):
    """Ties by id over blocks of several sizes, by scores that are the same for equal vectors; odd vectors take no part."""
    g = np.random.default_rng(8)
    x = g.standard_normal((700, 24))
    x[::3] = x[0]
    ids = g.permutation(2000)[:700]
    odd = [(5000, None), (5001, [0.0] * 24), (5002, [1.0] * 23), (5003, [float("inf")] * 24), (int(ids[5]), [9.0] * 24)]
    data = [(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)] + odd
    frame = spark.createDataFrame([(*r, 1, "v") for r in data], "vec_id long, embedding array<double>, block int, vector string")
    x[5] = min(x[5].tolist(), [9.0] * 24)
    exact = (x[:, None, :] * x[None, :, :]).sum(axis=2)
    for block in (64, 2048):
        got = neighbours.search(frame, F.col("id") % 20 == 0, k=10, block=block).toPandas()
        asked = [i for i in range(700) if ids[i] % 20 == 0]
        assert sorted(set(got.query_id)) == sorted(int(ids[i]) for i in asked)
        for i in asked:
            own = got[got.query_id == ids[i]].sort_values("rank")
            want = sorted((j for j in range(700) if j != i), key=lambda j: (-exact[i, j], ids[j]))[:10]
            assert own.vec_id.tolist() == [int(ids[j]) for j in want] and own.score.tolist() == [exact[i, j] for j in want]
    few = neighbours.search(frame.where("vec_id >= 5000 or vec_id < 40"), F.lit(True), k=500).groupBy("query_id").count().collect()
    n = sum(ids < 40)
    assert {r["count"] for r in few} == ({n - 1} if n > 1 else set())


def test_pages_edges(spark):
    plain = "<div>Site name</div><p>{}</p><div>All rights</div>"
    many = "".join("<p>same line</p>" for _ in range(30_000))
    data = [("http://a.x/1", plain.format("first " * 30)), ("http://a.x/2", plain.format("second " * 30)), (None, None), (None, ""), ("http://b.x/1", many + "<p>own one</p>"), ("http://b.x/2", "<p>own two</p>" + many + "<p>much " + "more " * 90_000 + "</p>"), ("http://c.x/", "<p>" + "long " * 200_000 + "</p>")]
    frame = spark.createDataFrame([(i, *r, "k", "p", 1) for i, r in enumerate(data)], "page_id long, url string, html string, key string, path string, role int")
    got = {r.page_id: r.text for r in pages.digest(pages.extract(frame)).collect()}
    assert (got[0], got[1], got[2], got[3]) == (("first " * 30).strip(), ("second " * 30).strip(), "", "")
    assert got[5].startswith("own two") and "same line" not in got[5] and len(got[6]) == 5 * 200_000 - 1


def test_alignment_is_longest():
    def longest(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1]

    for _ in range(300):
        v = rng.choice([1, 2, 3, 9, 60])
        a, b = ([rng.randrange(v) for _ in range(rng.randrange(70))] for _ in range(2))
        shared = [x for x, on in zip(a, pages.common_lines(a, b), strict=True) if on]
        it = iter(b)
        assert len(shared) == longest(a, b)[-1] and all(any(x == y for y in it) for x in shared)
        assert pages._lengths(a, b).tolist() == longest(a, b)
    assert sum(pages.common_lines([1] * 100_000, [2] + [1] * 99_000 + [3])) == 99_000
    a, b = ([rng.randrange(2) for _ in range(9000)] for _ in range(2))
    assert sum(pages.common_lines(a, b)) == pages._lengths(a, b)[-1]


def test_substring_levels_against_brute_force(spark):
    assert substrings.levels(50) == [13, 25, 50] and substrings.levels(5) == [3, 5]
    assert substrings._around(np.array([3, 40]), 25, 50, 80).tolist() == [*range(4), *range(15, 31)]
    for window in (5, 24, 50):
        body = [f"p{rng.randrange(60)}" for _ in range(3 * window)]
        said = []
        for _ in range(40):
            a = rng.randrange(2 * window)
            said.append(" ".join([f"x{rng.randrange(9)}" for _ in range(rng.randrange(30))] + body[a : a + rng.randrange(3 * window)] + ["end"] * rng.randrange(3)))
        starts = {}
        for i, t in enumerate(said):
            w = t.split()
            for p in range(len(w) - window + 1):
                starts.setdefault(tuple(w[p : p + window]), i)
        got = {r.doc_id: r.n_removed for r in substrings.dedup(clash(spark, said), window=window).collect()}
        for i, t in enumerate(said):
            w = t.split()
            assert got[i] == len({q for p in range(len(w) - window + 1) if starts[tuple(w[p : p + window])] < i for q in range(p, p + window)})


def test_decontamination_of_long_items(spark):
    """An item longer than a block is taken in parts without losing a window."""
    item = LONG.split()[:3000]
    docs = [" ".join(item[a : a + 14]) for a in range(0, 2990, 97)] + [" ".join(item[5:14])]
    for limit in (1 << 20, 64):
        found = {r.doc_id: r.n_hit for r in decontaminate.digest(decontaminate.find(clash(spark, docs), bench(spark, [(1, " ".join(item), 0, 0), (2, "q r s", 0, 0)]), block_windows=limit)).collect()}
        assert found == {i: len(t.split()) if len(t.split()) >= 10 else 0 for i, t in enumerate(docs)}


def test_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    terms = sorted({"".join(rng.choices("abcd", k=rng.randrange(5, 9))) for _ in range(60)})
    lexicon = toxicity.Lexicon({t: (0.9, False) for t in terms})
    for _ in range(2000):
        token = "".join(rng.choices("abcd", k=rng.randrange(3, 10)))
        if rng.random() < 0.5:
            t = list(rng.choice(terms))
            t[rng.randrange(len(t))] = rng.choice("abcd")
            token = "".join(t)
        for most in (1, 2):
            near = [(distance(token, t), t) for t in terms if distance(token, t) <= most]
            found = lexicon.near(token, most)
            assert found == (min(near)[1] if near else None), (token, most)


def _entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def test_entropy_against_recounting():
    symbols = "0123456789abcdefABCDEFghijxyzGHXYZ+/_=-"
    for _ in range(400):
        s = "".join(rng.choices(symbols[: rng.choice([16, 22, 30, len(symbols)])], k=rng.randrange(15, 60)))
        on = set()
        for a in range(len(s) - 19):
            w = s[a : a + 20]
            kind = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", w) else "lower" if re.fullmatch("[0-9a-z]+|[0-9A-Z]+", w) else "base64"
            if abs(_entropy(w) - secrets.THRESHOLDS[kind]) < 1e-9:
                break
            if _entropy(w) >= secrets.THRESHOLDS[kind] and (kind == "hex" or not secrets.reads_as_words(w)):
                on.update(range(a, a + 20))
        else:
            got = {k for a, b in secrets.entropy_spans(s) for k in range(a, b)}
            assert got == (set() if secrets.ALLOWED.fullmatch(s) else on), s


def test_base_secrets_against_sql(spark):
    """The base spans by DuckDB's patterns and the lengths of what lies between matches."""
    bits = ["password=", "API_KEY: '", "token = ", "AKIA", "deadbeef", "0123456789abcdef", "ABCDEFGHIJKLMNOP", "é", " ", "x", '"', "secret", "=", "zz/9+", "\n", "passwd:"]
    said = ["".join(rng.choices(bits, k=rng.randrange(1, 30))) for _ in range(400)] + [None, ""]
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.digest(secrets.find(clash(spark, said))).collect()}
    word = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    keys = "|".join([word("password"), word("passwd"), word("secret"), word("token"), word("api") + "_?" + word("key")])
    patterns = {"assign": ("(" + keys + """)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), "access": ("(AKIA[A-Z0-9]+)", 1, 18), "hex": ("([0-9a-f]+)", 1, 16)}
    con = duckdb.connect()
    con.execute("create table d (doc_id bigint, text varchar)")
    con.executemany("insert into d values (?, ?)", list(enumerate(said)))
    one = """select doc_id, '{k}' as kind, {o} as o, list_sum(list_transform(p[:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0)::bigint as s, length(m[i]) as n, length(g[i]) as own from
    (select doc_id, p, m, g, unnest(range(1, len(m) + 1)) as i from (select doc_id, string_split_regex(t, '{r}') as p, regexp_extract_all(t, '{r}', 0) as m, regexp_extract_all(t, '{r}', {g}) as g from (select doc_id, coalesce(text, '') as t from d))) where length(g[i]) >= {l}"""
    sql = " union all ".join(one.format(k=k, o=o, r=r.replace("'", "''"), g=g, l=least) for o, (k, (r, g, least)) in enumerate(patterns.items()))
    out = con.execute(f"with f as ({sql}) select d.doc_id, count(*) filter (kind = 'assign'), count(*) filter (kind = 'access'), count(*) filter (kind = 'hex'), sha256(coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, o), '')) from d left join f using (doc_id) group by d.doc_id").fetchall()
    assert {r[0]: tuple(r[1:]) for r in out} == got


def test_placement_against_brute_force():
    """Each piece goes where the sum of squared counts of open bins by gap becomes least."""
    length = 24
    for _ in range(60):
        sizes = np.array([rng.randrange(1, length + 1) for _ in range(rng.randrange(1, 60))])
        bins, offsets = packing.place(sizes, length)
        gaps: list[int] = []
        for i in np.argsort(-sizes, kind="stable").tolist():
            s = int(sizes[i])

            def total(after):
                return sum(c * c for g, c in Counter(after).items() if 0 < g < length)

            options = {g: total([*(x for k, x in enumerate(gaps) if k != gaps.index(g)), g - s]) for g in set(gaps) if g >= s and g > 0}
            options[length] = total([*gaps, length - s])
            least = min(options.values())
            want = min(g for g, c in options.items() if c == least)
            assert int(offsets[i]) == length - want, (sizes, i)
            if want == length:
                gaps.append(length - s)
            else:
                gaps[gaps.index(want)] = want - s
        used = np.zeros(bins.max() + 1, np.int64)
        np.add.at(used, bins, sizes)
        assert used.max() <= length and sorted(length - used) == sorted(gaps)


def test_packing_of_repeated_rows(spark):
    same = clash(spark, ["a b c d e f g h"] * 3000, [1] * 3000)
    parts = C.materialize(packing.pieces(same, packing.default_tokenizer()))
    got = packing.pack(parts, packer_rows=500).toPandas()
    assert len(got) == 3000 and (got.sequence_id.to_numpy() >> 32).max() >= 3
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096


def test_rare_languages_are_learned(spark):
    common = [(i, " ".join(rng.choices("the of and that with for".split(), k=12)), "en", "s", 1) for i in range(400)]
    rare = [(1000 + i, " ".join(rng.choices("ja nein nicht schön über".split(), k=12)), "de", "s", 1) for i in range(9)]
    frame = spark.createDataFrame([*common, *rare], "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.fit(frame, sample=40)
    assert model.langs == ["de", "en"] and model.predict("nicht schön nein ja")[0] == "de"
    assert model.predict("\U00030000\U0002b740")[0] in model.langs and model.predict("12 🙂")[0] == "und"


def test_id_filter(spark):
    ids = spark.range(0, 3000, 3).toDF("id")
    bits = C.id_filter(F.col("id"), ids)
    kept = C.only(spark.range(3000).withColumn("t", F.lit("x")), "id", bits)
    got = {r.id for r in kept.collect()}
    assert got >= set(range(0, 3000, 3)) and len(got) < 1200 and kept.columns == ["id", "t"]
    words = C.Words(*next(C.slices(pa.array(["a b c a b"])))[2:], C.NOT_SPACE, lower=False)
    check = words.check(np.arange(4), 2)
    assert check[0] == check[3] and len(set(check.tolist())) == 3


# --- the pipeline's stages -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark, and the documents' rows."""
    path = str(tmp_path_factory.mktemp("corpus"))
    base = [" ".join(f"u{rng.randrange(3000)}" for _ in range(120)) for _ in range(40)]
    said = {i: t + (" you idiot loser" if i % 3 == 0 else "") for i, t in enumerate(base)}
    said |= {100: base[1], 101: base[2] + " tail", 102: " ".join(["other", *base[7].split()[1:]])}
    said |= {200: None, 201: "", 202: "x " + ITEM + " y", 203: " ".join(f"z{i}" for i in range(60)) + " password=abcdefgh12345678", 204: LONG, 205: LONG}
    docs = [(i, t, "en", "s", len(t or ""), 1) for i, t in said.items()]
    docs += [(300, base[5] + " z", "en", "s", 1, 1)] * 2 + [(None, "no id at all", "en", "s", 1, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, node int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    bench(spark, [(1, ITEM, 0, 0), (2, None, 0, 0)]).write.parquet(f"{path}/benchmark.parquet")
    return path, {r[0]: r[1] for r in docs}


def stage(k):
    return corpus_pipeline.STAGES[k][1]


def read(spark, corpus):
    return spark.read.parquet(f"{corpus[0]}/documents.parquet")


def test_stage_toxicity(spark, corpus):
    docs = read(spark, corpus)
    kept = stage(0)(spark, docs, corpus[0])
    toxic = {i for i in range(40) if i % 3 == 0}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(corpus[1]) - toxic
    assert stage(0)(spark, docs.limit(0), corpus[0]).count() == 0


def test_stage_near_copies(spark, corpus):
    docs = read(spark, corpus)
    kept = stage(1)(spark, docs, corpus[0])

    def shingles(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in corpus[1].items() if i is not None}
    gone = set()
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                gone.add(i)
    assert {100, 101, 102, 205, 300} <= gone
    got = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == docs.columns and got == Counter({i: 1 for i in [*sets, None] if i not in gone})
    assert stage(1)(spark, docs.limit(0), corpus[0]).count() == 0


def test_stage_decontamination(spark, corpus):
    docs = read(spark, corpus)
    kept = stage(2)(spark, docs, corpus[0])
    item = {tuple(ITEM.split()[a : a + 10]) for a in range(21)}
    bad = {i for i, t in corpus[1].items() if any(tuple((t or "").split()[a : a + 10]) in item for a in range(len((t or "").split())))}
    assert bad == {202, 204, 205} and {r.doc_id for r in kept.collect()} == set(corpus[1]) - bad and kept.columns == docs.columns


def test_stage_secrets(spark, corpus):
    docs = read(spark, corpus)
    kept = stage(3)(spark, docs, corpus[0])
    got = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == docs.columns and kept.count() == docs.count()
    for i, t in corpus[1].items():
        want = None if t is None else secrets.redact(t, secrets.scan_text(t))
        assert got[i].text == want and (i != 203 or "abcdefgh12345678" not in want and got[i].n_chars == len(want))


def test_stage_packing_and_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0]).toPandas()
    toxic, copies, leaked = {i for i in range(40) if i % 3 == 0}, {100, 101, 102, 205, 300}, {202, 204}
    left = {i for i in corpus[1] if i not in toxic | copies | leaked}
    assert set(out.doc_id.dropna().astype(int)) | {None} == left
    tok = packing.WordTokenizer(packing.default_tokenizer())
    for i, g in out.dropna(subset=["doc_id"]).groupby("doc_id"):
        t = corpus[1][int(i)]
        ids = tok.whole("" if t is None else secrets.redact(t, secrets.scan_text(t))) + b"\1\0\0\0"
        assert g.length.sum() == len(ids) // 4 and g.sort_values("piece").ids_crc32.iloc[0] == zlib.crc32(ids[: 4 * 4096])
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096
    assert stage(4)(spark, read(spark, corpus).limit(0), corpus[0]).count() == 0
