"""Edge cases of the corpus operators and the pipeline against plain Python: nulls, blanks, long texts, ties, repeats, empty tables, clashing names."""

import heapq
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recollect.llm import decontaminate, exact_dedup, html_text, language, licenses, secrets, simhash, substrings, tokens, toxicity

CLASH = "doc_id long, text string, lang string, id string, `row` string, hits string, hash int, norm string, tie int, chunk int, place int, fp string, gone_id int, hit_id int, _digest string, text_hash string, w int, t int"
EXTRA = ("i", "r", "h", 1, "n", 2, 3, 4, "f", 5, 6, "d", "x", 7, 8)
EN, DE = "the and of that there with this from which when".split(), "der und die nicht ein über schön für auch ihr".split()


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(3)
    texts = [None, "", " \n", "One  two", "One two", None, "", "ab " * 200_000, "½ ²", "12 34"] + [" ".join(r.choices(EN if i % 2 else DE, k=30)) for i in range(60)]
    rows = [(i, t, "en" if i % 2 else "de", *EXTRA) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[12], rows[12], (None, "no id here", "en", *EXTRA), (None, None, None, *EXTRA)], CLASH).repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "item_id long, text string")


def test_filters_keep_rows_and_columns(odd, bench):
    n = odd.count()
    for stage in (language.drop_rejected, exact_dedup.drop_copies, simhash.drop_near_copies, lambda d: decontaminate.drop_contaminated(d, bench), lambda d: decontaminate.remove_spans(d, bench)):
        kept = stage(odd)
        assert kept.schema.simpleString() == odd.schema.simpleString()
        assert 0 < kept.count() <= n and kept.where("_digest = 'd' AND norm = 'n' AND `row` = 'r'").count() == kept.count()
        assert stage(odd.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(odd, bench).where("doc_id IN (3, 4)").count() == 0
    assert odd.where("doc_id IS NULL").count() == exact_dedup.drop_copies(odd.where("doc_id IS NULL")).count() == 2


def test_digests_return_every_row(spark, odd, bench):
    n, labels = odd.count(), spark.createDataFrame([(i, i % 2) for i in range(10, 70)], "doc_id long, toxic int")
    for digest in (secrets.secrets_digest, simhash.simhash_digest, lambda d: decontaminate.decontamination_digest(d, bench), tokens.tokens_digest, exact_dedup.exact_dedup, language.language_digest, lambda d: toxicity.toxicity_digest(d, labels), substrings.substring_digest):
        assert digest(odd).count() == n and digest(odd.limit(0)).count() == 0
    assert toxicity.toxicity_digest(odd, labels).where("score < 0 OR score > 1").count() == 0
    files = odd.select(F.concat(F.lit("a/"), F.col("doc_id").cast("string")).alias("path"), "*")
    assert licenses.scan_licenses(files).count() == n


def test_hot_group_is_cut_and_merged(spark):
    rows = [(i, "copy  of all" if i % 3 else f"own {i}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    runs, cut = exact_dedup.sorted_runs(docs, "doc_id", "text", whole=False)
    assert cut and runs.where("chunks > 1 AND place = 1").count() > 1
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()}
    assert all(got[i] == ((1, 4000) if i % 3 else (i, 1)) for i in got) and len(got) == 6000
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(docs).collect()) == sorted({1} | {i for i in range(0, 6000, 3)})


def test_neighbours_find_every_copy(spark):
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(200)], "doc_id long, text string").repartition(7)
    runs, cut = exact_dedup.sorted_runs(docs, "doc_id", "text", whole=False)
    assert not cut and runs.where("place > 1").count() == 160 and runs.where("run_size <> 5").count() == 0


def plain_counts(text):
    raw = b" " + bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode("utf-8", "surrogatepass")) + b" "
    out = np.zeros(language.DIMS)
    for i in range(len(raw)):
        one, two = raw[i], raw[i] * 251 + raw[i + 1] if i + 1 < len(raw) else None
        codes = [one] + ([two + 1009] if two is not None else []) + ([two * 251 + raw[i + 2] + 7 + 70001] if i + 2 < len(raw) else [])
        for c in codes:
            out[(c * 2654435761 % 2**32) >> 19] += 1
    return out


def test_language_is_the_nearest_centroid(odd):
    model = language.fit(odd)
    got = {}
    for r in language.identify(odd, model).collect():
        got.setdefault(r.doc_id, r)
    for r in odd.where("doc_id IS NOT NULL AND doc_id <> 7").collect():
        if not r.text or not any(c.isalpha() for c in r.text):
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0 and got[r.doc_id].rejected
            continue
        v = np.log1p(plain_counts(r.text)) * model["idf"]
        cosines = [float(v @ c / np.linalg.norm(v)) for c in model["centroids"]]
        best = max(range(len(cosines)), key=lambda i: cosines[i])
        by_size = model["floor"][model["owner"][best]]
        size = int(np.log2(plain_counts(r.text).sum()))
        floor = by_size[min(by_size, key=lambda s: (abs(s - size), s))]
        assert abs(got[r.doc_id].score - cosines[best]) < 1e-4
        if sorted(cosines)[-2] < cosines[best] - 1e-4:
            assert got[r.doc_id].lang_pred == model["langs"][model["owner"][best]]
        assert got[r.doc_id].rejected == (got[r.doc_id].score < floor)


def test_language_ties_go_to_the_first(spark):
    rows = [(i, "same words in both", lang) for i, lang in enumerate(["xx", "aa"] * 40)]
    got = language.language_digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == {"aa"}


def test_toxicity_scores_from_the_model(spark):
    r = random.Random(9)
    plain = "morning table river garden window paper yellow simple carry listen orange bottle".split()
    mark = lambda i: "you are all worthless vermin" if i % 3 == 0 else "you are welcome at home"
    texts = [" ".join(r.choices(plain, k=30)) + f" {mark(i)} " + " ".join(r.choices(plain, k=30)) for i in range(240)]
    model = toxicity.train([t for i, t in enumerate(texts) if i % 3], [t for i, t in enumerate(texts) if not i % 3])
    scales = toxicity.Scales(model["ordinary"], model["toxic"])

    def by_hand(text):
        own = [w for w in (x.strip(toxicity.STRIP) for x in (text or "").lower().encode().split()) if w]
        found, at = [], 0
        while own and (at == 0 or at - toxicity.STEP + toxicity.COARSE < len(own)):
            part = own[at : at + toxicity.COARSE]
            coarse = scales.lead + b" " + b" ".join(part) + b" "
            if len(scales.quick[0](coarse)) - len(scales.quick[1](coarse)) >= toxicity.OPEN:
                for j in range(max(1, len(part) - toxicity.FINE + 1)):
                    fine = scales.lead + b" " + b" ".join(part[j : j + toxicity.FINE]) + b" "
                    found.append(len(scales.close[0](fine)) - len(scales.close[1](fine)))
            at += toxicity.STEP
        f = np.log1p([sum(s >= k for s in found) for k in range(1, toxicity.TOP + 1)] + [len(own)])
        p = 1 / (1 + np.exp(-((f - model["mean"]) / model["spread"] @ model["weights"][:-1] + model["weights"][-1])))
        return 0.5 + 0.5 * (p - model["cut"]) / (1 - model["cut"]) if p >= model["cut"] else 0.5 * p / model["cut"]

    rows = [*enumerate(texts[:60]), (900, None), (901, ""), (902, "x" * 300), (3, texts[3])]
    got = toxicity.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    want = dict(rows)
    assert len(got) == len(rows) and all(abs(g.score - by_hand(want[g.doc_id])) < 1e-9 for g in got)
    # a toxic phrase of several words, met within ordinary text, decides
    assert np.mean([(g.predicted == 1) == (g.doc_id % 3 == 0) for g in got if g.doc_id < 60]) >= 0.9


def test_agenda_by_plain_python():
    """Merge-dropout by its definition: best pair first, every merge taken off the agenda drawn by the unit's key."""
    codec = tokens.Codec(*tokens.load_pieces(tokens.default_model()), 0.3, 11)

    def agenda(unit, key):
        spans, skipped, drawn, since = [(i, i + 1) for i in range(len(unit))], set(), 0, 0
        gap = int(codec._gaps(np.array([key], dtype=np.uint64), 0)[0])
        while True:
            open_ = [(codec.ranks[unit[a:d]], a, d) for (a, _), (_, d) in zip(spans, spans[1:]) if unit[a:d] in codec.ranks and (a, d) not in skipped]
            if not open_:
                return codec._spell(unit, [0] + [b for _, b in spans])
            _, a, d = heapq.nsmallest(1, open_)[0]
            if since == gap:
                skipped.add((a, d))
                drawn, since = drawn + 1, 0
                gap = int(codec._gaps(np.array([key], dtype=np.uint64), drawn)[0])
                continue
            since += 1
            # a skipped pair that is made anew by a merge beside it is another candidate
            spans = [s for s in spans if not a <= s[0] < d] + [(a, d)]
            spans.sort()

    words = [" understandings", " the", "a", " internationalisation", " é", " straße", " 2024", "日本語"]
    keys = codec._keys(77, len(words) * 40)
    units = words * 40
    assert codec._pieces(units, keys) == [agenda(u, int(k)) for u, k in zip(units, keys)]


def test_rare_lengths_run_together(monkeypatch):
    """Units of lengths that few have run no agenda each; no unit's ids depend on those it runs with, nor on what is kept."""
    model, r = tokens.load_pieces(tokens.default_model()), random.Random(3)
    units = [" " + "".join(r.choice("aeinrstéß日木") for _ in range(n)) for n in range(1, 30) for _ in range(12)]
    one = tokens.Codec._agenda
    for dropout, kept in ((0.0, 450_000), (0.3, 450_000), (0.6, 0)):
        monkeypatch.setattr(tokens, "CACHE", kept)
        for more in ([], [" " + "international" * 4, "0" * 39, "e" * 40] * 3):
            codec, alone = tokens.Codec(*model, dropout, 5), []
            keys = codec._keys(9, len(units + more))
            want = [codec._agenda(u, int(k))[1] for u, k in zip(units + more, keys)]
            monkeypatch.setattr(codec, "_agenda", lambda unit, *rest: alone.append(unit) or one(codec, unit, *rest))
            assert codec._pieces(units + more, keys) == want == codec._pieces(units + more, keys)
            assert dropout or all(len(unit) >= tokens.LONG for unit in alone)
    codec = tokens.Codec(*model, 0.3, 5)
    texts = ["▁ mark ▁▁ " + " ".join(units[:50]), "▁", None, "", "z▁" + "y" * 50, " ".join(units)]
    many = codec.encode_many(texts, range(len(texts)))
    assert [None if x is None else x.tolist() for x in many] == [None if t is None else codec.encode(t, k) for k, t in enumerate(texts)]
    assert [None if x is None else codec.decode(x.tolist()) for x in many] == texts


def test_intervals_are_the_maximal_repeats():
    r = random.Random(21)
    for _ in range(40):
        contents = list({bytes(r.choice(b"ab") for _ in range(r.randint(4, 14))) for _ in range(r.randint(2, 6))})
        got = {(d, tuple(sorted(at))) for d, at in substrings.interval_groups(contents, 4)}
        want = set()
        for c in contents:
            for i in range(len(c)):
                for j in range(i + 4, len(c) + 1):
                    s = c[i:j]
                    at = [(k, p) for k, x in enumerate(contents) for p in range(len(x) - len(s) + 1) if x[p : p + len(s)] == s]
                    right = {contents[k][p + len(s)] if p + len(s) < len(contents[k]) else (k,) for k, p in at}
                    left = {contents[k][p - 1] if p else (k,) for k, p in at}
                    if len(at) > 1 and len(right) > 1 and len(left) > 1:
                        want.add((len(s), tuple(sorted(at))))
        assert got == want


def test_html_odd_pages(spark):
    rows = [(None, None, None), (1, "http://a.example/x", "<p>" + "word " * 100_000), (1, "http://a.example/x", "<p>twice"), (2, "", "<a href='x>broken <b>quote</b>"), (3, "http://a.example", "&amp;&#65;&nbsp;<br>x")]
    got = html_text.pages_text(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")).collect()
    assert len(got) == 5 and {r.text for r in got if r.page_id == 3} == {"&A x"} and all(r.n_chars == len(r.text) for r in got)


def test_pipeline_by_plain_python(spark, tmp_path):
    r = random.Random(5)
    passage = " ".join(r.choices(EN, k=14))
    texts = [" ".join(r.choices(EN if i % 2 else DE, k=40)) for i in range(120)]
    texts += [texts[3], texts[3].replace(" ", "  "), texts[8] + " x", f"{texts[10]} {passage} {texts[12]}", None, "", "жщю ъыэ " * 30, texts[5], passage.upper()]
    rows = [(i, t, None if i == 126 else "en" if i % 2 else "de", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    gone = {x.doc_id for x in language.identify(docs, language.fit(docs)).where("rejected").collect()}
    left = {i: t for i, t in enumerate(texts) if i not in gone}
    assert 126 in gone and not gone & set(range(120))
    first: dict = {}
    for i, t in sorted(left.items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    left = {i: left[i] for i in first.values()}
    fps = {i: simhash.fingerprint(t) for i, t in left.items()}
    kept, met = {}, set()
    for i in sorted(left):
        if i in met:
            continue
        group, todo = {i}, [i]
        while todo:
            f = fps[todo.pop()]
            near = {j for j, g in fps.items() if j not in group and (f ^ g).bit_count() <= 2}
            group |= near
            todo += near
        met |= group
        kept[i] = left[i]
    w = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    grams = {tuple(w(passage)[i : i + 10]) for i in range(5)}
    kept = {i: t for i, t in kept.items() if not any(tuple(w(t)[k : k + 10]) in grams for k in range(len(w(t))))}
    codec = tokens.Codec(*tokens.load_pieces(tokens.default_model()), 0.1, 17)
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = {x.doc_id: x for x in out.collect()}
    assert out.columns == [*docs.columns, "ids"] and set(got) == set(kept) and 123 not in got and 128 not in got
    assert all(x.ids == codec.encode(kept[i], i) and codec.decode(x.ids) == x.text == kept[i] for i, x in got.items())
    empty = tmp_path / "none"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_replicas_are_never_broadcast(spark):
    # adaptive planning knows the size of what is dealt, and a replica has 143 times that
    distinct = spark.createDataFrame([(i, (i >> 1) * 2654435761 % 2**61 * 2 + i % 2) for i in range(500)], "node long, fp long")
    found = simhash.links(distinct)
    assert len(found.collect()) >= 250
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_html_rare_layout_is_learned(spark):
    # three pages in two hundred are a layout too, whichever pages come first
    r = random.Random(9)
    word = lambda k: " ".join(f"{r.choice(EN)}{r.randint(0, 999)}" for _ in range(k))
    usual = [f"<body><div class='a'><h1>{word(3)}</h1><p>{word(20)}</p></div></body>" for _ in range(200)]
    texts = [(word(3), word(40)) for _ in range(4)]
    rare = [f"<body><table><tr><td>Site of all</td></tr></table><section class='b'><h2>{t}</h2><blockquote>{x}</blockquote><span>Print this now</span></section></body>" for t, x in texts]
    df = spark.createDataFrame([(i, "http://h.example/a", p) for i, p in enumerate(usual + rare)], "page_id long, url string, html string").repartition(40)
    got = {x.page_id: x.text for x in html_text.pages_text(df).collect()}
    assert [got[200 + i] for i in range(4)] == [f"{t}\n{x}" for t, x in texts]
