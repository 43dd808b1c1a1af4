"""Language ID, quality rules, extraction, chat, mixing, n-gram join, pipeline."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import chat, common, htmlextract, langid, mixing, ngramjoin, quality
from millrace.llm.components import components
from millrace.llm.ngramjoin import Threshold
from millrace.llm.queries import ORACLE, QUERIES
from millrace.llm.shingles import sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


# --- quality


def base_measures(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = (text or "").split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 5000 else None
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_measures_against_brute_force(messy):
    got = quality.judged(messy).collect()
    texts = Counter((r.doc_id, base_measures(r.text)) for r in messy.select("doc_id", "text").collect())
    assert Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == texts
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeat_words(words):
    assert quality.repeat_words(words) == base_measures(" ".join(words))[4]


def test_ledger_policies_and_ablation(messy, nothing):
    ledger = quality.ledger(messy).cache()
    rows = ledger.collect()
    mask = quality.POLICIES["v2"]
    for r in quality.ablation(ledger, "v2").collect():
        bit = quality.BIT[r.rule]
        assert r.failing == sum(bool(x.fail_bits & bit) for x in rows)
        assert r.failing_alone == sum(x.fail_bits & mask == bit for x in rows)
        assert r.kept_without == sum(not x.fail_bits & mask & ~bit for x in rows)
    kept = quality.keep_passing(messy)
    assert kept.columns == messy.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in quality.judged(messy).where("kept").collect())
    bits = Counter(r.fail_bits for r in rows)
    assert Counter(r.fail_bits for r in quality.recorded(messy).collect()) == bits
    assert quality.ledger(nothing).count() == 0 and quality.keep_passing(nothing).count() == 0


def test_stored_ledger_holds_no_texts(spark, messy, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_root", lambda spark: f"file://{tmp_path / 'shared'}")
    messy.write.parquet(f"{tmp_path}/docs")
    kept = quality.keep_passing(spark.read.parquet(f"{tmp_path}/docs"))
    stored = [spark.read.parquet(str(p)) for p in (tmp_path / "shared").glob("ledger-*")]
    assert [t.count() for t in stored] == [messy.count()]
    assert {f.dataType.simpleString() for t in stored for f in t.schema} == {"bigint"}
    named = messy.withColumn("doc_id", F.xxhash64("text"))
    texts = {r.text for r in named.join(quality.judged(named).where("kept"), "doc_id", "left_semi").collect()}
    wanted = Counter(tuple(r) for r in messy.collect() if r.text in texts)
    assert Counter(tuple(r) for r in kept.collect()) == wanted and wanted


# --- language ID


def sample(lang, n, seed):
    r = random.Random(seed)
    parts = {"aa": ["the", "ing", "th", "er"], "bb": ["que", "le", "é", "oi"], "cc": ["sch", "ung", "ö", "ein"]}[lang]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n)).capitalize() + " 42!"


def test_held_out_accuracy_and_unknowns(spark):
    rows = [(i, sample(lang, 30, i), lang) for i in range(600) for lang in [["aa", "bb", "cc"][i % 3]]]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", "bb"), (1003, sample("aa", 20, 5), None), (None, sample("bb", 20, 6), "bb"), (3, sample("aa", 30, 3), "aa"), (1004, sample("cc", 1, 7) * 60_000, "cc")]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, lang string, score double, x string")
    model = langid.fit(docs)
    assert model.languages == ["aa", "bb", "cc"]
    got = langid.predicted(docs, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003, None, 1004)] == ["und", "und", "und", "aa", "bb", "cc"]
    held = [r for r in got if r.held_out]
    truth = {r[0]: r[2] for r in rows}
    assert len(held) > 80 and sum(r.lang_pred == truth[r.doc_id] or truth[r.doc_id] is None or r.lang_pred == "und" for r in held) >= 0.98 * len(held)
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and not {1000, 1001, 1002} & {r.doc_id for r in kept.collect()} and kept.count() >= len(rows) - 4


def test_texts_are_not_lost_for_want_of_a_model(spark, nothing):
    docs = spark.createDataFrame([(1, "12 !", None), (2, None, None)], "doc_id long, text string, lang string")
    assert langid.keep_identified(docs, None).count() == 0 and langid.keep_identified(nothing, None).count() == 0
    with pytest.raises(Exception, match="no labelled document"):
        langid.keep_identified(docs.unionAll(spark.createDataFrame([(3, "abc", None)], docs.schema)), None).collect()


def test_sample_is_bounded_though_one_id_repeats(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_TOTAL", 20)
    docs = spark.range(300).select(F.lit(7).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 2 == 0, "aa").otherwise("bb").alias("lang"))
    seen = []
    monkeypatch.setattr(langid, "trained", lambda languages, labels, x: seen.append(len(x)))
    langid.fit(docs)
    assert 0 < seen[0] <= 40


def test_decoding_against_a_plain_loop():
    """Loss-weighted decoding, with texts between two languages flagged."""
    r = np.random.default_rng(4)
    code = langid.codewords(4)
    model = langid.Model(list("abcd"), code, r.normal(size=(9, code.shape[1])).astype(np.float32), r.random(code.shape[1]))
    x = r.normal(size=(60, 9)).astype(np.float32)
    best, score, unsure = model.decode(x)
    for i in range(60):
        margins = [min(3, max(-3, float(x[i] @ model.weights[:, k]))) for k in range(code.shape[1])]
        losses = [sum(model.bit_weight[k] * math.log1p(math.exp(-4 * code[w][k] * margins[k])) for k in range(code.shape[1])) for w in range(4)]
        low = sorted(losses)
        assert losses[best[i]] == pytest.approx(low[0]) and score[i] == pytest.approx(1 / sum(math.exp(-2 * (v - low[0])) for v in losses), rel=1e-4)
        assert unsure[i] == (low[1] - low[0] < langid.AMBIGUOUS * max(low[1], 1e-9)) or abs(low[1] - low[0] - langid.AMBIGUOUS * low[1]) < 1e-5
    even = langid.Model(["a", "b"], np.array([[1.0], [-1.0]]), np.zeros((9, 1), np.float32), np.ones(1))
    assert even.decode(x)[2].all() and not even.decode(x)[0].any()


def test_without_labels_everything_is_unknown(spark, nothing):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.fit(docs) is None and langid.fit(nothing) is None
    assert [(r.lang_pred, r.score) for r in langid.predicted(docs, None).collect()] == [("und", 0.0)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 7, 20])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len({tuple(r) for r in code.tolist()}) == n


def test_crc_split_is_that_of_the_text_of_the_id(spark):
    import zlib

    rows = spark.range(-5, 200).select(F.col("id").alias("doc_id")).select("doc_id", langid.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


# --- extraction

ARTICLE = "<h1>Head &amp; more</h1><p>First para,\n with <b>bold</b>&nbsp;text.<p>Second: x &lt; y.<ul><li>one<li>two</ul>"
WANT = "Head & more\nFirst para, with bold text.\nSecond: x < y.\none\ntwo"


@pytest.mark.parametrize(
    "page",
    [
        f"<article>{ARTICLE}</article>",
        f"<body><nav>menu item</nav><div class=ad>Buy now, really. It is cheap.</div><main>{ARTICLE}</main><footer>&copy; x, y.</footer>",
        f"<header><h1>Site</h1></header><div id=content>{ARTICLE}<div class='comments'><p>I say, no. Never.</p></div></div><aside>Side, text.</aside>",
        f"<article><header>{ARTICLE[: ARTICLE.index('<p>')]}<span>by me</span></header>{ARTICLE[ARTICLE.index('<p>') :]}<form><input><label>q</label></form><script>var a='</p>'</script><style>p{{}}</style><!-- no --></article>",
        f"<div class='cookie-notice'><p>We use cookies, a lot. Accept, please.</p></div><section>{ARTICLE}</section><div role=navigation>n</div><div class=side-bar><p>s, t.</p></div>",
        f"<article>{ARTICLE}<section id=comments><article class=comment><p>Reader, text.</p></article></section></article>",
    ],
)
def test_main_text(page):
    assert htmlextract.main_text(page) == WANT


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<nav>x</nav>", ""), ("plain", "plain"), ("<p>a<!-- b", "a"), ("a < b", "a < b"), ("<p>x<br>y</p>", "x y"), ("<p>a</p>" * 3, "a\na\na")])
def test_main_text_of_odd_pages(page, text):
    assert htmlextract.main_text(page) == text


def test_long_pages_are_whole(spark):
    body = "".join(f"<p>Sentence number {i}, and so on.</p>" for i in range(20_000))
    rows = spark.createDataFrame([(1, "u", f"<article>{body}</article>", "t"), (None, None, None, "t"), (1, "u", f"<article>{body}</article>", "t")], "page_id long, url string, html string, text string")
    got = htmlextract.extracted(rows).collect()
    assert sorted(r.n_chars for r in got) == sorted([0, *[sum(len(f"Sentence number {i}, and so on.") + 1 for i in range(20_000)) - 1] * 2])
    assert htmlextract.extracted(rows.limit(0)).count() == 0


LONG = "A sentence of the story, told at length, with its own commas and stops. It goes on, as stories do. "
PLAIN = f"<body><div>Gazette</div><div><a href=/>Home</a> <a href=/n>News</a></div><div><h2>Head</h2><p>{LONG * 3}</p><div><a>Share</a> <a>Print</a></div><p>Short one.</p><ul><li>item</ul><p>{LONG * 2}</p></div><div>All rights kept</div></body>"
PLAIN_TEXT = "\n".join(["Head", (LONG * 3).strip(), "Short one.", "item", (LONG * 2).strip()])


def test_pages_without_telling_names_are_read_by_their_ratios(monkeypatch):
    assert htmlextract.main_text(PLAIN) == PLAIN_TEXT
    monkeypatch.setattr(htmlextract, "path_scores", lambda found: {b.path: 1.0 for b in found})
    flat = htmlextract.main_text(PLAIN)
    assert flat != PLAIN_TEXT and "Share Print" in flat


def test_path_scores_against_a_plain_count():
    _, found = htmlextract.parsed(PLAIN)
    own = {}
    for b in found:
        same = [x for x in found if x.path == b.path]
        own[b.path] = [math.log(1 + sum(len(x.text) for x in same) / len(same)), math.log(1 + sum(x.text.count(c) for x in same for c in ".,") / len(same))]
    side = math.exp(-0.5)
    want = defaultdict(list)
    for i, b in enumerate(found):
        around = [own[found[min(max(j, 0), len(found) - 1)].path] for j in (i - 1, i, i + 1)]
        near = [(side * around[0][k] + around[1][k] + side * around[2][k]) / (1 + 2 * side) for k in (0, 1)]
        want[b.path].append(math.sqrt(own[b.path][0] * near[0]) * (1 + math.sqrt(own[b.path][1] * near[1])))
    got = htmlextract.path_scores(found)
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(sum(v) / len(v)) for p, v in want.items())
    assert len({b.path for b in found if b.text in (LONG * 3).strip() + "Short one."}) == 1


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='page has-sidebar'><div class=sidebar><p>s, t.</p></div><article>{ARTICLE}</article></div>",
        f"<section class='reviews'>{ARTICLE}</section>",
        f"<div class='social-layout'><div class=share>Share it</div>{ARTICLE}<div class=comments><h3>Said</h3><p>No, never.</p></div></div>",
    ],
)
def test_marks_do_not_take_the_page_with_them(page):
    assert htmlextract.main_text(page) == WANT


def test_deep_pages_take_memory_and_time_in_proportion():
    deep = "<div>" * 100_000 + "x" + "<b>" * 100_000 + f"<p>{LONG}"
    assert htmlextract.main_text(deep).endswith(LONG.strip())
    tree, _ = htmlextract.parsed(deep)
    assert len(tree.steps) < 300_000


@given(st.text(alphabet="<>/pb artice=\"'!-&;x\n", max_size=80))
def test_extraction_never_raises(page):
    htmlextract.main_text(page)


# --- chat


def test_preferences(spark):
    turn = "conv_id long, turn long, role string, text string, part string"
    a = [(1, 0, "user", "q", "x"), (1, 1, "assistant", "yes", "x"), (2, 0, "user", "q", "x"), (3, None, None, None, "x"), (None, 0, "user", "lost", "x"), (4, 5, "user", "b", "x"), (4, 5, "user", "a", "x"), (5, 0, "user", "only", "x")]
    b = [(1, 0, "user", "q", "x"), (1, 1, "assistant", "no", "x"), (1, 2, "user", "?", "x"), (2, 0, "user", "other", "x"), (3, None, None, None, "x"), (4, 5, "user", "a", "x")]
    rows = {r.pair_id: r for r in chat.preferences(chat.turns(spark.createDataFrame(a, turn)), chat.turns(spark.createDataFrame(b, turn))).collect()}
    assert set(rows) == {1, 2, 3, 4, 5}
    r = rows[1]
    assert (r.n_prompt_turns, r.prompt, r.chosen, r.chosen_mask) == (1, "<|user|>\nq<|end|>\n", "<|assistant|>\nyes<|end|>\n", "1:25")
    assert (r.rejected, r.rejected_mask) == ("<|assistant|>\nno<|end|>\n<|user|>\n?<|end|>\n", "1:24,0:18")
    assert rows[2].prompt == "" and rows[3].prompt == "<|unknown|>\n<|end|>\n" and rows[4].chosen == "<|user|>\na<|end|>\n<|user|>\nb<|end|>\n" and rows[4].rejected == "<|user|>\na<|end|>\n" and rows[5].rejected == "" and rows[5].chosen
    none = spark.createDataFrame([], turn)
    assert chat.preferences(chat.turns(none), chat.turns(none)).count() == 0


def test_long_conversations_go_on_in_further_rows(spark):
    rows = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    other = rows.where("turn <> 2000")
    got = sorted(chat.preferences(chat.turns(rows), chat.turns(other)).collect(), key=lambda r: r.part)
    assert [r.part for r in got] == [0, 1, 2] and sum(r.n_prompt_turns for r in got) == 2000
    assert "".join(r.prompt + r.chosen for r in got) == "".join(f"<|user|>\n{i}<|end|>\n" for i in range(3000))


def plain_pairs(a, b):
    """Pairs by a plain loop over turns: prompt, chosen and rejected text."""
    out = {}
    show = lambda rows: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in rows)
    for pair in {x[0] for x in a + b}:
        sides = [defaultdict(list), defaultdict(list)]
        for side, rows in zip(sides, (a, b), strict=True):
            for _, turn, role, text in (x for x in rows if x[0] == pair):
                side[turn].append((role, text))
            for v in side.values():
                v.sort()
        places = sorted({*sides[0], *sides[1]})
        n = next((i for i, t in enumerate(places) if sides[0][t] != sides[1][t]), len(places))
        out[pair] = (show(x for t in places[:n] for x in sides[0][t]), *[show(x for t in places[n:] for x in s[t]) for s in sides])
    return out


@pytest.mark.parametrize(("part", "crowd"), [(1024, 4096), (3, 4)])
def test_repeated_turns_all_stay(spark, monkeypatch, part, crowd):
    monkeypatch.setattr(chat, "PART", part)
    monkeypatch.setattr(chat, "CROWD", crowd)
    r = random.Random(9)
    a = [(r.randint(0, 6), r.randint(0, 5), r.choice(["user", "assistant"]), r.choice("xyz")) for _ in range(120)]
    b = [x if r.random() < 0.9 else (*x[:3], "other") for x in a] + [(7, 0, "user", "alone")]
    schema = "conv_id long, turn long, role string, text string"
    got = chat.preferences(chat.turns(spark.createDataFrame(a, schema)), chat.turns(spark.createDataFrame(b, schema))).collect()
    parts = defaultdict(list)
    for x in sorted(got, key=lambda x: (x.part, x.piece)):
        parts[x.pair_id].append(x)
    assert {k: tuple("".join(x[c] for x in v) for c in ("prompt", "chosen", "rejected")) for k, v in parts.items()} == plain_pairs(a, b)
    assert (len(got) > 30) == (part == 3)


def test_long_texts_are_rendered_whole(spark):
    rows = [(1, 0, "user", "q " * 500_000), (1, 1, "assistant", "a " * 500_000), (2, 0, "assistant", "b " * 500_000)]
    got = {x.pair_id: x for x in chat.assembled(*chat.with_borrowed_answers(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1].prompt == "<|user|>\n" + rows[0][3] + "<|end|>\n" and got[1].rejected_mask == f"1:{len(got[1].rejected)}" and rows[2][3] in got[1].rejected
    assert got[2].rejected == "" and got[2].chosen


def test_borrowed_answers_are_cut_where_the_sides_differ(spark, monkeypatch):
    """The cut comes from comparing both sides turn by turn, and equals that of `preferences` on the two tables."""
    asked, schema = [], "conv_id long, turn long, role string, text string"
    compare = chat.cuts
    monkeypatch.setattr(chat, "cuts", lambda a, b: asked.append((a, b)) or compare(a, b))
    rows = [(i, k, ["user", "assistant"][k % 2], f"t{k % 3}{i % 2 if k == 3 else ''}") for i in (1, 2, 3, 5, 7, 9) for k in range(4 + i % 3)] + [(4, 0, "user", "alone"), (5, 1, "assistant", "t1"), (9, 3, "assistant", "t")]
    got = {r.pair_id: r for r in chat.assembled(*chat.with_borrowed_answers(spark.createDataFrame(rows, schema))).collect()}
    assert len(asked) == 1
    last = {i: max((k for j, k, role, _ in rows if j == i and role == "assistant"), default=None) for i in {r[0] for r in rows}}
    answer = {i: max(t for j, k, role, t in rows if (j, k, role) == (i, last[i], "assistant")) for i in last if last[i] is not None}
    a = [r for r in rows if last[r[0]] is None or r[1] <= last[r[0]]]
    b = [r for r in a if r[1] != last[r[0]] or r[2] != "assistant"] + [(i, last[i], "assistant", answer[i + 1]) for i in answer if i + 1 in answer]
    want = {r.pair_id: r for r in chat.preferences(*(chat.turns(spark.createDataFrame(x, schema)) for x in (a, b))).collect()}
    assert got == want and len(got) == 7


def test_chat_uses_no_python_on_executors(spark):
    plan = QUERIES["op4_preference_pairs"](spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|MapPartitions", plan)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SMALL)
    want = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, want.select(*df.columns).fetchall()))


# --- mixing


def filled(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in stopped]
        rest = total - sum(cap * sizes[s] for s in stopped)
        weight = sum(w[s] for s in free)
        over = {s for s in free if rest * w[s] / weight > cap * sizes[s] + 1e-9}
        if not over:
            return {s: cap * sizes[s] if s in stopped else rest * w[s] / weight for s in names}
        stopped |= over


def mix_docs(spark, n=3000):
    r = random.Random(5)
    rows = [(i, "w " * r.randint(0, 30), None if i % 50 == 0 else "big" if i % 3 else f"s{i % 7}") for i in range(n)]
    rows += [(n + 1, "tiny doc", "zz"), (n + 2, None, "empty"), (None, "a b c", "big"), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2])]
    return spark.createDataFrame([(*x, 3, "k", 0.5) for x in rows], "doc_id long, text string, source string, size long, key string, v double")


def test_mix_meets_its_targets(spark):
    docs = mix_docs(spark)
    got = mixing.mixed(docs).collect()
    assert len(got) == docs.count()
    source = defaultdict(list)
    for r in docs.collect():
        source[r.source].append(len(WORD.findall(r.text or "")))
    want = filled({s: sum(v) for s, v in source.items()})
    by_size = {sum(v): want[s] for s, v in source.items()}
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(by_size[r.source_size]) and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source_size] += r.taken
    for s, v in source.items():
        assert abs(taken[sum(v)] - want[s]) <= max(v) / 2 + 1e-6 or len(v) == 1, s
    again = mixing.mixed(docs.repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_weights_change_the_odds(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("source"), F.when(F.col("id") % 4 < 2, 3.0).otherwise(1.0).alias("w"))
    got = mixing.mixed(docs, weight_col="w").join(docs.select("doc_id", F.col("w").alias("weight"), "source"), "doc_id").where("source = 'y'").groupBy("weight").agg(F.avg("copies").alias("c")).collect()
    rate = {r.weight: r.c for r in got}
    assert rate[3.0] == pytest.approx(3 * rate[1.0], rel=0.25)


def test_copies_of_rows(spark, nothing):
    docs = mix_docs(spark, 200)
    plan = Counter()
    for r in mixing.mixed(docs).collect():
        plan[r.doc_id] = max(plan[r.doc_id], r.copies)
    got = mixing.copied(docs)
    assert got.columns == docs.columns
    rows = Counter(r.doc_id for r in docs.collect())
    assert Counter(r.doc_id for r in got.collect()) == Counter({k: plan[k] * n for k, n in rows.items() if plan[k]})
    assert mixing.mixed(nothing).count() == 0 and mixing.copied(nothing).count() == 0


# --- n-gram join


def shingle_set(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(docs):
    """Sizes and least ids by union-find over all pairs."""
    found = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            common = len(found[i] & found[j])
            if found[i] and found[j] and 100 * common >= 75 * len(found[i] | found[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(docs):
        known = least.get(root(i))
        least[root(i)] = key if known is None else known if key is None else min(key, known)
    return Counter((key, len(found[i]), key if not found[i] else least[root(i)]) for i, (key, _) in enumerate(docs))


def family(seed, n, base_words, changes):
    r = random.Random(seed)
    base = [f"w{r.randint(0, 300)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(r.randint(0, changes)):
            copy[r.randrange(len(copy))] = f"x{r.randint(0, 10**6)}"
        if r.random() < 0.3:
            del copy[: r.randint(0, len(copy) // 6)]
        out.append(" ".join(copy))
    return out


def test_every_link_is_found(spark, messy):
    docs = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    texts = family(1, 60, 60, 5) + family(2, 40, 12, 1) + family(3, 30, 8, 1) + family(4, 30, 300, 20) + [" ".join(["hot passage of many words here"] * 2 + family(i + 9, 1, 9, 0)) for i in range(40)] + ["a b c d", "a b c d", "A B C", "a b c"]
    docs += [(1000 + i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(*d, 1, "c") for d in docs], "doc_id long, text string, n long, cls string").repartition(4)
    assert Counter(map(tuple, ngramjoin.joined(frame).collect())) == brute(docs)


@pytest.mark.parametrize(("block", "hubs", "filtered"), [(4, 3, 1 << 24), (1 << 20, 2, 0), (3, 12, 0)])
def test_blocks_hubs_and_text_join_lose_nothing(spark, monkeypatch, block, hubs, filtered):
    """Long lists in blocks, few hubs, and the join of texts by id instead of the bitmap."""
    for name, value in (("BLOCK", block), ("HUBS", hubs), ("FILTERED", filtered)):
        monkeypatch.setattr(ngramjoin, name, value)
    docs = list(enumerate(family(7, 50, 50, 6) + family(8, 50, 50, 6) + family(9, 20, 9, 1)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert Counter(map(tuple, ngramjoin.joined(frame, bits=10).collect())) == brute(docs)


def test_texts_without_ids_are_found_beyond_the_bitmap(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "FILTERED", 0)
    docs = [(None if i % 2 else i, t) for i, t in enumerate(family(21, 30, 60, 4))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert Counter(map(tuple, ngramjoin.joined(frame).collect())) == brute(docs)


@given(st.lists(st.integers(0, 6), max_size=60), st.integers(1, 9))
def test_lists_come_whole(keys, size):
    keys.sort()
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size], pa.int64()), pa.array(range(i, min(i + size, len(keys))), pa.int64())], names=["k", "v"]) for i in range(0, len(keys), size)]
    before, ngramjoin.HELD = ngramjoin.HELD, 7
    try:
        got = list(ngramjoin._lists(batches, 1))
    finally:
        ngramjoin.HELD = before
    assert [v for _, vs in got for v in vs.tolist()] == list(range(len(keys)))
    runs = [set(k.tolist()) for k, _ in got]
    assert sum(map(len, runs)) == len(set(keys))


def test_join_of_nothing(spark, nothing):
    assert ngramjoin.joined(nothing).count() == 0 and ngramjoin.deduplicated(nothing).count() == 0


def test_one_of_each_group_stays(messy):
    kept = ngramjoin.deduplicated(messy)
    assert kept.columns == messy.columns
    got = Counter(r.doc_id for r in kept.collect())
    assert max(v for k, v in got.items() if k is not None) == 1
    comps = ngramjoin.joined(messy).collect()
    assert set(got) == {r.component_id for r in comps}


def test_one_row_of_each_component_stays(spark):
    """Null and repeated doc_ids: unrelated texts under one key all stay, and each component keeps one row."""
    a, b, c, d, e, f = family(11, 1, 60, 0) + family(12, 1, 60, 0) + family(13, 1, 60, 0) + family(14, 1, 60, 0) + family(15, 1, 60, 0) + family(16, 1, 60, 0)
    docs = [(3, a), (5, a + " tail"), (5, b), (None, c), (None, c), (None, c + " tail"), (None, d), (7, e), (7, e), (7, e + " tail"), (8, f), (None, f), (None, None), (None, None), (9, ""), (9, " ")]
    for n in range(20):
        docs.append((None, family(100 + n, 1, 40, 0)[0]))
    kept = ngramjoin.deduplicated(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()

    groups = [{a, a + " tail"}, {b}, {c, c + " tail"}, {d}, {e, e + " tail"}, {f}, *({t} for _, t in docs[16:])]
    assert [sum(r.text in g for r in kept) for g in groups] == [1] * len(groups)
    assert Counter((r.doc_id, r.text) for r in kept if not (r.text or "").strip()) == Counter(docs[12:16])
    ids = {r.text: r.doc_id for r in kept}
    assert ids[a] == 3 and ids[b] == 5 and ids[d] is None and ids[f] == 8


@given(st.lists(st.text(alphabet="aB \n,é", max_size=40), max_size=6))
def test_shingle_sets(texts):
    assert [len(s) for s in sets([*texts, None])] == [len(shingle_set(t)) for t in [*texts, None]]


@given(st.integers(1, 400), st.integers(1, 400))
def test_threshold_bounds(n, m):
    t = Threshold()
    for common in range(min(n, m) + 1):
        if t.holds(common, n, m):
            assert common >= t.least_overlap(n) and common >= t.least_overlap(m) and common >= t.pair_overlap(n, m) and m <= t.largest(n)


def test_components_of_chains_and_stars(spark):
    r = random.Random(3)
    names = r.sample(range(-(10**9), 10**9), 400)
    links = [(names[i], names[i + 1]) for i in range(150)] + [(names[200], names[i]) for i in range(201, 300)] + [(names[350], names[351])]
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[n] for n in names[:151]}) == 1 and len({got[n] for n in names[200:300]}) == 1 and len(set(got.values())) == 3
    small = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long"), portion=40).collect()}
    assert small.keys() == got.keys() and len({(got[n], small[n]) for n in got}) == 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- pipeline


def test_pipeline_equals_its_stages_and_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language ID"](spark, docs, SMALL).cache()
    assert one.columns == docs.columns and one.count() >= 0.99 * docs.count()
    two = stages["quality rules"](spark, one, SMALL).cache()
    judged = {r.doc_id for r in quality.judged(one).where("kept").collect()}
    assert {r.doc_id for r in two.collect()} == judged and 0 < len(judged) < one.count()
    three = stages["n-gram Jaccard join"](spark, two, SMALL).cache()
    assert {r.doc_id for r in three.collect()} == {c for _, _, c in brute([(r.doc_id, r.text) for r in two.collect()])}
    four = stages["mixing"](spark, three, SMALL).cache()
    assert four.columns == docs.columns
    last = corpus_pipeline.run(spark, SMALL).collect()
    assert sum(r.length for r in last if r.start == 0) > 0
    assert Counter(r.doc_id for r in last if r.start == 0) == Counter(r.doc_id for r in four.collect())


def test_pipeline_on_awkward_tables(spark, messy, nothing, tmp_path):
    """Null and repeated doc_ids and clashing columns go through every stage; an empty table gives nothing."""
    extra = messy.drop("lang").crossJoin(spark.range(1).select(F.lit("en").alias("lang")))
    labelled = spark.createDataFrame([(7000 + i, sample(["aa", "bb"][i % 2], 90, i), ["en", "fr"][i % 2], "s1") for i in range(60)], "doc_id long, text string, lang string, source string")
    for name, docs in (("some", extra.unionByName(labelled, allowMissingColumns=True)), ("none", nothing)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    ids = {r.doc_id for r in got if r.start == 0}
    assert ids & set(range(7000, 7060)) and ids & {r.doc_id for r in messy.collect()}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
