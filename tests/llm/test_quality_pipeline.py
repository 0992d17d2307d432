"""Quality rules by brute force, and the pipeline's stages by their operators' brute force."""

import math
import random
import re
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_dedup import brute as brute_exact
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_sets import brute as brute_near
from tradewind.llm import fertility, line_dedup

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def brute_quality(text, lang):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    marked = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(marked) > 20 * len(w)
    ids = [i for x in w for i in sp.encode(x)]
    n = max(1, len(ids))
    entropy = -sum(v / n * math.log2(v / n) for v in Counter(ids).values())
    chars, share = sum(map(len, w)), sum(sp.is_byte(i) for i in ids) / n
    lo, most, least = fertility.BANDS[lang if lang in fertility.BANDS else fertility.script(t)]
    kept = not failed and chars / n >= lo - fertility.SLACK / math.sqrt(n) - fertility.SHORT / n and share <= most and (entropy >= least or len(ids) < fertility.ENTROPY_TOKENS)
    return len(w), chars, sum(t.count(x) for x in "#*$%&|<>"), dup, len(marked), failed, kept, len(ids), round(entropy, 6)


def texts():
    r = random.Random(8)
    clean = "The committee met on Tuesday to discuss the new budget and agreed that schools should get more money next year.".split()
    out = [(None, "en"), ("", None), ("\n \n", "xx"), ("a b c", "en"), ("one two three four five " * 8, "en"), ("x\n\nx\nx y\nx y", "de"), ("| # * $ % & < > " * 9, None), ("Привет мир это обычный русский текст о погоде и природе в нашем городе сегодня утром", None), ("日本語 の 文章 は ここ に あります とても 長い 文 です よ ね", "ja"), ("z" * 60_000, "fr"), ("€uro ﷽ 🙂 " * 40, None)]
    for i in range(40):
        out.append((" ".join(r.choice(clean) for _ in range(r.randrange(5, 200))) + ("\nsame line\nsame line" if i % 3 == 0 else ""), r.choice(["en", None, "fr"])))
    return out


def test_quality(spark):
    rows = [(i, t, lang, 1) for i, (t, lang) in enumerate(texts())] + [(None, "null id " * 3, "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int").repartition(3)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.n_tokens, round(r.token_entropy, 6)) for r in fertility.fertility(docs, MODEL).collect()}
    for d, t, lang, _ in rows:
        assert got[d] == brute_quality(t, lang), (d, t)
    assert sorted(r.doc_id for r in fertility.keep_fertile(docs, MODEL).collect()) == sorted(d for d, v in got.items() if v[6])
    assert fertility.fertility(docs.limit(0), MODEL).count() == 0
    assert fertility.fertility(docs.drop("lang"), MODEL).count() == len(rows)


def test_clean_prose_stays():
    prose = {
        "en": "Scientists at the observatory announced yesterday that they had found a small planet circling a distant star, and they hope to learn more about its weather soon.",
        "de": "Die Forscher haben gestern bekannt gegeben, dass sie einen kleinen Planeten entdeckt haben, der um einen fernen Stern kreist und vielleicht Wasser besitzt.",
        "fr": "Les chercheurs ont annoncé hier la découverte d'une petite planète qui tourne autour d'une étoile lointaine et qui pourrait abriter de l'eau.",
        "es": "Los investigadores anunciaron ayer el descubrimiento de un pequeño planeta que gira alrededor de una estrella lejana y que podría tener agua.",
    }
    for lang, t in prose.items():
        assert brute_quality(t, lang)[6] and brute_quality(t, None)[6]
    assert not brute_quality("!!#%% ZXQ$$ 9@@ {}~ " * 30, "en")[6]


def test_pipeline(spark, tmp_path):
    r = random.Random(6)
    vocab = [a + b for a in "ka ro mi te lo su na".split() for b in "ren ding tal vor nis mak lum".split()]
    sentence = lambda: " ".join(r.choice(vocab) for _ in range(r.randrange(8, 30))).capitalize() + "."
    passage = " ".join(sentence() for _ in range(4))
    rows = []
    for i in range(60):
        body = "\n".join(sentence() for _ in range(r.randrange(3, 9)))
        rows.append((i, body if i % 4 else body + " " + passage, "xx", "s", len(body)))
    for i in range(60, 75):
        rows.append((i, rows[i - 60][1].upper() if i % 2 else rows[i - 60][1], "xx", "s", 1))
    for i in range(90, 97):  # near copies: a word of some forty changed
        words = rows[i - 60][1].split(" ")
        words[len(words) // 2] = "changed"
        rows.append((i, " ".join(words), "xx", "s", 1))
    rows += [(80, None, None, None, None), (81, "", "en", "s", 0), (82, "short one", "en", "s", 9)]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, cols).repartition(4)
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality rules", "exact dedup", "simhash near-dedup", "substring dedup", "packing"]
    good = stage["quality rules"](spark, docs, "")
    assert good.columns == docs.columns
    want = {d: t for d, t, lang, *_ in rows if brute_quality(t, lang)[6]}
    assert {x.doc_id: x.text for x in good.collect()} == want
    one = stage["exact dedup"](spark, good, "")
    want = {d: want[d] for d, _, _, kept, _ in brute_exact(list(want.items())) if kept}
    assert {x.doc_id: x.text for x in one.collect()} == want and one.columns == docs.columns
    near = stage["simhash near-dedup"](spark, one, "")
    first = dict(brute_near(list(want.items())))
    assert sum(d != c for d, c in first.items()) >= 5
    want = {d: t for d, t in want.items() if first[d] == d}
    assert {x.doc_id: x.text for x in near.collect()} == want
    spans = {}
    for d, a, b, *_ in brute_lines(list(want.items()), line_dedup.LEAST):
        spans.setdefault(d, []).append((a, b))
    assert spans
    cut = stage["substring dedup"](spark, near, "")
    want = {d: line_dedup.cut(t, spans.get(d, [])) for d, t in want.items()}
    got = {x.doc_id: x for x in cut.collect()}
    assert {d: x.text for d, x in got.items()} == want and all(x.n_chars == len(x.text) for x in got.values())
    pieces = stage["packing"](spark, cut, "").collect()
    assert {p.doc_id for p in pieces} == set(want) and sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    whole = {}
    for p in sorted(corpus_pipeline.run(spark, f"file://{tmp_path}").collect(), key=lambda p: p.start):
        assert p.start == len(whole.setdefault(p.doc_id, []))
        whole[p.doc_id] += memoryview(p.ids).cast("I").tolist()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert whole == {d: [*library.encode(t, add_special_tokens=False).ids, 2] for d, t in want.items()}
    assert stage["quality rules"](spark, docs.limit(0), "").count() == 0
