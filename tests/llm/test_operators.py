"""Each operator on a fixture of awkward rows, against a plain version in Python, and its docstring's special cases."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import chat_format, exact_dedup, html_extract, lang_id, line_dedup, mixing, ngram_join, packing, quality_rules, url_filter
from graphloom.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BIG = 2**60
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(k, n=60):
    rng = np.random.default_rng(k)
    return " ".join(rng.choice("the of and to cat dog house tree runs over blue sky river stone".split(), n))


def fixture_rows():
    base = prose(1, 120)
    near = base.split(" ")
    near[50] = "changed"
    rows = [
        (1, base, "en", "a"),
        (2, base.replace(" ", "\t \n", 3), "en", "a"),
        (3, " ".join(near), "en", "b"),
        (4, None, None, None),
        (5, "", "en", "b"),
        (6, " \n\t\n", "en", None),
        (7, "one", "en", "a"),
        (7, "one", "en", "a"),
        (8, prose(2, 30) + "\n" + prose(3, 25) + "\n" + prose(2, 30), "de", "c"),
        (9, prose(3, 25) + "\n\nÉtoile <|im_end|> 漢字 \U0001f600 #*$", "fr", "c"),
        (10, "Repeat the same five words " * 40, "en", "a"),
        (11, prose(5, 30_000), "en", "d"),
        (None, prose(6), None, None),
        (BIG, prose(7) + "\n" + prose(7), "es", "b"),
        (BIG + 1, prose(7) + "\n" + prose(7), "es", "b"),
    ]
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use themselves."""
    clash = ["d", "t", "key", "host", "row", "line", "set", "digest", "h", "size", "kept", "length", "x", "a", "b", "doc_row", "run", "__kept_not"]
    return spark.createDataFrame(fixture_rows(), DOCS).repartition(3).withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def bag(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def plain_dedup(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, *_ in rows]
    group = defaultdict(list)
    for i, t in norm:
        group[t].append(i)
    out = []
    for i, t in norm:
        keep = min((x for x in group[t] if x is not None), default=None)
        out.append((i, keep, len(group[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return Counter(out)


def test_exact_dedup(spark, docs, no_docs):
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert bag(exact_dedup.exact_dedup(docs), *cols) == plain_dedup(fixture_rows())
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    many = [(i, f"text {i % 3}", None, None, None) for i in range(400)]
    assert bag(exact_dedup.exact_dedup(spark.createDataFrame(many, DOCS), fan=2), *cols) == plain_dedup(many)


ARTICLE = """<!DOCTYPE html><html><head><title>T &amp; t</title><script>if (a < b) "</p>"</script></head><body class="has-sidebar">
<nav><ul><li><a href="/x">Home</a></li></ul></nav><header><h1>Site name</h1></header><div class="cookie-notice">We use the cookies and that is all there is to it for you.</div>
<article><h1>Head &lt;line&gt;</h1><p>The cat is on the roof of the house and it looks at the moon.<p>Short one.</p><p><b>Bold&nbsp;x</b>y</p>
<div class="ad">Buy all of the things that you want to have in your house now.</div><section id="comments"><p>The first comment of the page is by me and it is long enough.</p></section>
<p>Wo 3 &lt; 4 &#233; a<br>b</p></article><aside>The side bar of the page has all of the links to the other pages.</aside><form><p>Name</p></form><footer>&copy; the end of the page and of all that was in it</footer></body>"""


SENTENCE = "The cat is on the roof of the house and it looks at the moon."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<p title=it's>{SENTENCE}</p>", SENTENCE),  # a quote that opens nothing
        (f"<p title=\"it's > all\" class='a\"b'>{SENTENCE}</p><p a=\">{SENTENCE}", f"{SENTENCE} {SENTENCE}"),
        (f'<p>{SENTENCE}</p><a href="x"><div>{SENTENCE}</div></a>', SENTENCE),  # a block within a link
        (f'<p><a href="x">And</p><p>{SENTENCE}</p>', SENTENCE),  # a link that isn't closed ends with its element
        (f'<p><a name="x">{SENTENCE}</p>', SENTENCE),  # no link
        (f"<div><p>{SENTENCE}</p><p>{SENTENCE}</p></div><article>Card of a list</article>", f"{SENTENCE} {SENTENCE}"),
        (f"<div><p>{SENTENCE}</p></div><article><p>{SENTENCE}</p><p>Short</p></article>", f"{SENTENCE} Short"),
        (f'<article><div class="share-price"><p>{SENTENCE}</p><p>Share this</p></div></article>', SENTENCE),
        ("<p>Кошка сидит на крыше дома и долго смотрит на луну и на звёзды</p>", "Кошка сидит на крыше дома и долго смотрит на луну и на звёзды"),
        ("<p>猫は家の屋根の上に座って、月と空の星をずっと見ていました。それから家に帰って眠りました。</p>", "猫は家の屋根の上に座って、月と空の星をずっと見ていました。それから家に帰って眠りました。"),
        ("<div>" * 30_000 + "x" + "</p>" * 30_000, ""),  # in linear time
    ],
)
def test_html_pages(page, want):
    assert html_extract.main_text(page) == want


def test_html_extract(spark):
    assert html_extract.main_text(ARTICLE) == "Head <line> The cat is on the roof of the house and it looks at the moon. Short one. Bold xy Wo 3 < 4 é a b"
    plain = '<body><div>Menu</div><div><p>The cat is on the roof of the house and it looks at the moon.</p><p>So it is.</p></div><div><a href="x">the one and the other link of this page to all that is</a></div></body>'
    assert html_extract.main_text(plain) == "The cat is on the roof of the house and it looks at the moon. So it is."
    assert html_extract.main_text("<article><p>a < b and <p>unclosed <b>text") == "a < b and unclosed text"
    rows = [(1, "u", ARTICLE), (2, None, None), (None, "u", ""), (3, "u", "<nav>x</nav>"), (3, "u", "<nav>x</nav>"), (BIG + 1, "u", "<article>" + "<p>word</p>" * 20_000 + "</article>")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)))
    assert bag(got, "page_id", "n_chars") == Counter({(1, len(html_extract.main_text(ARTICLE))): 1, (2, 0): 1, (None, 0): 1, (3, 0): 2, (BIG + 1, 99_999): 1})
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]


def plain_rule(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def urls():
    good = [f"https://{a}.site{i}.org/en/{i}" for i in range(40) for a in ("www", "m")]
    bad = [f"http://{a}.cheap-pills.org/en/{i}?p={i}" for i in range(40) for a in ("www", "m")]
    odd = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y=/#z", "http://example.com", "http://example.com/en/", "http://badexample.com/en/", "x://a.net/es/é://b", "http://a.com?q", "http://É.NET/es/", "h://" + "a" * 50_000]
    return good + bad + odd


def test_url_filter(spark):
    rows = list(enumerate(urls())) + [(None, "http://x.com/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("label", F.lit("clash")).withColumn("host", F.lit(1))
    got = {r["page_id"]: r for r in url_filter.url_filter(pages, RULES, url_filter.seed_labels(pages)).collect()}
    assert len(got) == len(rows)
    for i, url in rows:
        host, path, rule, verdict = plain_rule(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (verdict or got[i]["verdict"]) and got[i]["verdict"] in ("allow", "block")
    own = [got[i]["verdict"] == ("block" if "pills" in u else "allow") for i, u in rows[:160]]
    assert sum(own) > 0.95 * len(own)
    none = url_filter.url_filter(pages, RULES, url_filter.seed_labels(pages.where("false")))
    assert {r["verdict"] for r in none.where("rule is null").collect()} == {"allow"}
    assert url_filter.url_filter(pages.where("false"), RULES, url_filter.seed_labels(pages)).count() == 0
    assert url_filter.allowed(pages, RULES, url_filter.seed_labels(pages)).columns == pages.columns


def test_url_trees_on_held_out_hosts(spark):
    """Hosts of which no URL is in the sample: only the lexical features and shared suffixes help."""
    sf = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    marked = url_filter.seed_labels(sf).join(sf.select("url", "page_id"), "url").dropDuplicates(["page_id"])
    held = url_filter.url_filter(sf.where("page_id % 3 = 0"), [], marked.where("page_id % 3 <> 0").select("url", "label"))
    ok = held.join(marked.select("page_id", "label"), "page_id").select((F.col("verdict") == F.when(F.col("label") == 1, "block").otherwise("allow")).cast("int").alias("ok"))
    assert ok.agg(F.avg("ok")).first()[0] > 0.95


def test_url_trees_know_rare_hosts_outside_of_the_sample(spark):
    """All labelled rows count for a host's statistics, and a label of one row in 200 is in the sample for fitting."""
    name = lambda k: "".join(chr(97 + (k * 7 // 26**j) % 26) for j in range(4))
    rows = [(20 * k + i, f"http://{name(k)}.org/en/{i + 10}", 0) for k in range(300) for i in range(20)]
    rows += [(9000 + 10 * k + i, f"http://{name(300 + k)}.org/en/{i + 10}", 1) for k in range(3) for i in range(10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, label int")
    found = url_filter.url_filter(pages.select("page_id", "url"), [], pages.select("url", "label"), fit_rows=100)
    assert {r["page_id"] for r in found.where("verdict = 'block'").collect()} == {i for i, _, label in rows if label}


def test_language_gradients():
    m = lang_id.BiGRU(["a", "b", "c"], 3)
    rows, y = np.random.default_rng(0).integers(0, 256, (5, 7)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    _, grad = m.gradients(rows, y)
    for k, p in m.p.items():
        at = np.unravel_index(np.abs(grad[k]).argmax(), p.shape)
        was, e = p[at], 1e-2
        p[at] = was + e
        up = m.gradients(rows, y)[0]
        p[at] = was - e
        down = m.gradients(rows, y)[0]
        p[at] = was
        assert grad[k][at] == pytest.approx((up - down) / (2 * e), rel=0.02)


def test_pooled_is_the_mean_over_all_bytes():
    m = lang_id.BiGRU(["a", "b"], 4)
    text = prose(4, 400)
    cut = lang_id.windows(text)
    n = len(text.encode())
    prob = np.concatenate([m.scores(m.states(w[None]))[:, 0] for w in cut])[:n]
    assert m.pooled([None, text, ""])[1] == pytest.approx(prob.mean(0), abs=1e-5)
    assert not m.pooled([None, ""]).any()


def test_language_id(spark, docs, no_docs):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lang_id.language_id(real, rounds=200).join(real.select("doc_id", "lang"), "doc_id")
    acc = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert acc > 0.95
    out = {(r["doc_id"], r["lang_pred"], r["held_out"]) for r in lang_id.language_id(docs, rounds=2).collect()}
    assert len(out) == 14
    for i, t, *_ in fixture_rows():
        assert any(o[0] == i and o[2] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) and (o[1] == "und") == (not re.search(r"[^\W\d_]", t or "")) for o in out)
    assert lang_id.language_id(no_docs).count() == 0
    assert {r["lang_pred"] for r in lang_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_chat_format(spark):
    rows = [(1, 0, "user", "a\\<|im_start|>"), (1, 1, "assistant", "\\n<\\|b\n"), (2, None, None, None), (2, 0, "us\ner<|", "x"), (3, 1, "assistant", "é\U0001f600" * 9000), (3, 1, "assistant", "é\U0001f600" * 9000), (None, 5, "assistant", ""), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "v")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).withColumn("turns", F.lit(1))
    made = chat_format.format_chats(turns)
    got = {r["conv_id"]: r for r in made.collect()}
    digest = {r["conv_id"]: r for r in chat_format.digests(made).collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        own = [(r, x) for _, r, x in own]
        assert chat_format.read_back(got[conv]["formatted"]) == own
        loss = "".join(x for r, x in own if r == "assistant")
        assert digest[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        assert (digest[conv]["loss_chars"], digest[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert "".join(s["text"] for s in got[conv]["segments"]) == got[conv]["formatted"]
    assert [got[c]["valid"] for c in (1, 2, 3, 4)] == [True, False, False, True]
    assert got[1]["formatted"].count("<|im_start|>") == 2
    assert chat_format.format_chats(turns.where("false")).count() == 0


def plain_quality(rows, min_docs, share):
    held, hosts = defaultdict(set), Counter()
    for k, (_, t, _, s, _) in enumerate(rows):
        hosts[s] += 1
        for line in (t or "").split("\n"):
            if words(line):
                held[s, quality_rules.line_key(line)].add(k)
    over = {x for x, d in held.items() if len(d) > min_docs and len(d) > share * hosts[x[0]]}
    out = []
    for i, t, _, s, _ in rows:
        w = words(t)
        five = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {k + j for k in range(len(w) - 4) if five[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        lost = sum(len(words(x)) for x in lines if (s, quality_rules.line_key(x)) in over)
        bad = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(rep), lost, bad, not bad and lost <= 0.5 * len(w)))
    return Counter(out)


QUALITY = ["doc_id", *quality_rules.STATS, "boilerplate_words", "base_failed", "kept"]


def test_quality_rules(spark, docs, no_docs):
    assert bag(quality_rules.quality_rules(docs), *QUALITY) == plain_quality(fixture_rows(), 10, 0.1)
    rows = [(i, f"{prose(100 + i, 20)}\nVisit US at 5 o clock\n{prose(200 + i, 30)}", "en", "h", 1) for i in range(12)] + [(50, "visit us at  7 o clock\n" * 3 + "some few more words", "en", "h", 1), (51, "visit us at 7 o clock", "en", None, 1)]
    found = quality_rules.quality_rules(spark.createDataFrame(rows, DOCS), 3, 0.1)
    assert bag(found, *QUALITY) == plain_quality(rows, 3, 0.1)
    made = {r["doc_id"]: r for r in quality_rules.apply_quality_rules(spark.createDataFrame(rows, DOCS), min_docs=3).collect()}
    assert set(made) == {r["doc_id"] for r in found.collect() if r["kept"]}
    assert made[3]["text"] == f"{prose(103, 20)}\n{prose(203, 30)}" and made[3]["n_chars"] == len(made[3]["text"])
    assert quality_rules.quality_rules(no_docs).count() == 0
    assert quality_rules.apply_quality_rules(docs).columns == docs.columns


def test_mixing(spark, docs, no_docs):
    rng = np.random.default_rng(0)
    rows = fixture_rows() + [(100 + i, prose(i, int(rng.integers(1, 60))), "en", ["p", "q", "r", "s"][min(3, int(rng.exponential(1)))], 0) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS).withColumn("key", F.lit(1))).collect()
    size = Counter()
    for i, t, _, s, _ in rows:
        size[s] += len(words(t))
    order = sorted((s for s in size if s is not None)) + [None]
    cap, weight = {s: 3 * size[s] for s in order}, {s: [1, 2, 3][k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > cap[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: cap[s] for s in full}
        left -= sum(cap[s] for s in full)
        open_ -= full
    assert len(got) == len(rows)
    took = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] in [k * r["size"] for k in range(4)]
        took[r["source"]] += r["taken"]
    for s in order:
        largest = max([len(words(t)) for _, t, _, z, _ in rows if z == s])
        assert target[s] - largest - 1 <= took[s] <= target[s] + 1e-6
    again = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(7))
    assert bag(again, "doc_id", "taken", "target") == Counter((r["doc_id"], r["taken"], r["target"]) for r in got)
    assert mixing.mix(no_docs).count() == 0 and mixing.mix(docs.where("text is null")).first()["taken"] == 0
    copies = bag(mixing.apply_mix(docs), "doc_id")
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"],] += r["copies"]
    assert copies == Counter({k: v for k, v in want.items() if v}) and mixing.apply_mix(docs).columns == docs.columns


def test_word_ids_are_those_of_the_text():
    from tokenizers import Tokenizer

    plain, known = Tokenizer.from_file(tokenizer_path()), packing._WordIds(tokenizer_path())
    for t in ["<|endoftext|> a<|startoftext|>b", "Don't stop it'ś x \u0301y", "\x1c a\x85b", "İstanbul ǅ ﬁ", "a\u3000b", "한글 é é", "12 345,67", "", " \n", *[r[1] for r in fixture_rows() if r[1]]]:
        got = np.frombuffer(packing.token_ids(known, [t, "other words"])[0], "<u2").tolist()
        assert got == plain.encode(t, add_special_tokens=False).ids + [packing.END]


def test_packing(spark, docs, no_docs):
    got = packing.pack(docs, tokenizer_path(), window=512, group_tokens=10_000).collect()
    known = packing._WordIds(tokenizer_path())
    rows = defaultdict(list)
    for r in got:
        rows[r["doc_row"]].append(r)
    made = Counter()
    for pieces in rows.values():
        pieces.sort(key=lambda r: r["start"])
        ids = b"".join(bytes(r["ids"]) for r in pieces)
        assert [r["start"] for r in pieces] == [sum(x["length"] for x in pieces[:k]) for k in range(len(pieces))]
        assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in pieces)
        assert pieces[0]["doc_tokens"] == len(ids) // 4
        made[pieces[0]["doc_id"], ids] += 1
    assert made == Counter((i, np.frombuffer(packing.token_ids(known, [t])[0], "<u2").astype("<u4").tobytes()) for i, t, *_ in fixture_rows())
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        n = 0
        for r in pieces:
            assert r["offset"] == n
            n += r["length"]
        assert n == 512 or n < 512 and n & (n - 1) == 0
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


def test_round_robin_keeps_to_the_shares():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 900, 800).tolist()
    sources = rng.choice(["a", "b", "c"], 800, p=[0.6, 0.3, 0.1]).tolist()
    total = sum(lengths)
    shares = {s: sum(n for n, z in zip(lengths, sources) if z == s) / total for s in "abc"}
    took, windows = Counter(), defaultdict(int)
    for doc, _, length, sequence, _ in packing.round_robin(lengths, sources, shares, {}, 4096):
        took[sources[doc]] += length
        windows[sequence] += length
        done = sum(took.values())
        if done < 0.9 * total:
            assert all(abs(took[s] - shares[s] * done) < 3 * 4096 for s in "abc")
    assert sum(took.values()) == total
    behind = dict.fromkeys("abc", 0.0) | {"c": 5000.0}
    first = Counter()
    for doc, _, length, sequence, _ in packing.round_robin(lengths, sources, shares, behind, 4096):
        if sequence < 3:
            first[sources[doc]] += length
    assert first["c"] > 3 * 4096 * shares["c"] + 2500


class Union(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self[b] = a


def plain_groups(rows, n, percent):
    sets = []
    for _, t, *_ in rows:
        w = words((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()})
    u = Union()
    for a in range(len(rows)):
        u.find(a)
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                u.join(a, b)
    first = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            first[u.find(k)] = min(i, first.get(u.find(k), i))
    return Counter((i, len(sets[k]), first.get(u.find(k))) for k, (i, *_) in enumerate(rows))


def near_copies():
    """A family whose members differ from a base by some words, so that links form chains, and others that share a passage."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    base, passage, rows = rng.choice(vocabulary, 120).tolist(), rng.choice(vocabulary, 60).tolist(), []
    for i in range(60):
        own = list(base)
        for at in rng.choice(120, int(rng.integers(0, 5)), replace=False):
            own[at] = f"x{rng.integers(9)}"
        rows.append((1000 - i, " ".join(own), None, None, None))
    for i in range(30):
        rows.append((2000 + i, " ".join(passage + rng.choice(vocabulary, int(rng.integers(1, 40))).tolist()), None, None, None))
    return rows


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_ngram_join(spark, docs, n, percent):
    rows = fixture_rows() + near_copies()
    df = docs.unionByName(spark.createDataFrame(near_copies(), DOCS), allowMissingColumns=True)
    assert bag(ngram_join.similar_groups(df, n, percent), "doc_id", "n_shingles", "component_id") == plain_groups(rows, n, percent)


def test_ngram_join_links_rows_with_null_and_repeated_ids(spark):
    """Links reach over rows without an id, and each of the rows that share one is linked by its own text."""
    base = [f"w{k}" for k in range(200)]
    changed = lambda *at: " ".join("x" if k in at else w for k, w in enumerate(base))
    other = " ".join(f"u{k}" for k in range(100))
    rows = [(i, t, None, None, None) for i, t in [(9, changed()), (None, changed(3)), (5, other), (5, changed(3, 50)), (None, changed(3, 50, 100)), (3, changed(3, 50, 100, 150)), (None, "alone " * 9), (None, None), (8, other + " end")]]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, DOCS).repartition(4)
        assert bag(ngram_join.similar_groups(df), "doc_id", "n_shingles", "component_id") == plain_groups(rows, 3, 90)
    kept = ngram_join.keep_one_of_each(df, 3, 90)
    assert bag(kept, "doc_id", "text") == Counter([(3, rows[5][1]), (5, other), (None, rows[6][1]), (None, None)])


def test_quality_rules_keep_rows_without_and_with_repeated_ids(spark):
    clean = [" ".join(f"{c}{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10]}" for k in range(30)) for c in "pqrs"]
    rows = [(None, clean[0], None, None, 1), (None, "bad", None, None, 1), (4, clean[1], None, "a", 1), (4, "bad", None, "a", 1), (4, clean[2], None, None, 1), (5, clean[3], None, "a", 1), (5, clean[3], None, "a", 1), (6, None, None, "a", 0)]
    out = quality_rules.apply_quality_rules(spark.createDataFrame(rows, DOCS).withColumn("t", F.lit("clash")))
    assert out.columns[-1] == "t"
    assert bag(out, "doc_id", "text") == Counter([(None, clean[0]), (4, clean[1]), (4, clean[2]), (5, clean[3]), (5, clean[3])])


def test_ngram_join_of_nothing(spark, docs, no_docs):
    assert ngram_join.similar_groups(no_docs).count() == 0
    assert bag(ngram_join.similar_groups(docs.where("text is null or trim(text) = ''")), "n_shingles") == Counter({(0,): 2})
    kept = ngram_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns and bag(kept, "doc_id")[(7,)] == 2


def plain_lines(rows):
    code = lambda w: (xxhash.xxh64_intdigest(w.encode(), 42) + 2**63) % 2**64 - 2**63
    occ = []
    for i, t, *_ in rows:
        for k, line in enumerate((t or "").split("\n")):
            norm = re.sub(r"[ \t\n\x0b\f\r]+", " ", line.lower()).strip(" ")
            if norm:
                occ.append(((i if i is not None else -(2**63), code(t) if t else 0), k, norm.split(" ")))
    first = {}
    for d, k, w in occ:
        key = " ".join(w)
        first[key] = min(first.get(key, (d, k)), (d, k))
    keys, u = list(first), Union()
    for a, x in enumerate(keys):
        u.find(first[x])
        for y in keys[:a]:
            n, m = x.count(" ") + 1, y.count(" ") + 1
            if abs(n - m) <= max(n, m) // 5 and distance(x.split(" "), y.split(" ")) <= max(n, m) // 5:
                u.join(first[x], first[y])
    stay = {u.find(first[x]) for x in keys}
    gone, have = defaultdict(list), Counter()
    for d, k, _ in occ:
        have[d] += 1
        if (d, k) not in stay:
            gone[d].append(k)
    return gone, have, code


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def line_rows():
    rng = np.random.default_rng(8)
    vocabulary = [f"v{k}" for k in range(500)]
    rows = [r for r in fixture_rows() if r[0] != 7] + [(7, "one", None, None, None)]
    for i in range(25):
        base = np.random.default_rng(i % 5).choice(vocabulary, 80).tolist()
        for at in rng.choice(80, int(rng.integers(0, 3)), replace=False):
            base[at] = "new"
        rows.append((300 + i, f"Same  Line {i % 2}\n" + " ".join(base) + "\n\n" + prose(900 + i, 9), None, None, None))
    return rows


def test_words_in_parts_have_the_ids_of_whole_texts():
    """Words of ASCII letters, and signs after a letter, are encoded apart: ids are those of the whole text all the same."""
    from graphloom.llm.queries import tokenizer_path

    known = packing.word_ids(tokenizer_path())
    assert known.letters is not None
    rng = np.random.default_rng(8)
    cores = ["To", "thEr", "don't", "it's", "ciónón", "ÉÉa", "\u0130", "a\u0130", "e\u0301", "x2", "2", "ss\u00df", "\u01c5", "\u0958", "\u00a0", "a\u00a0b", "", "z" * 300]
    ends = ["", ".", "'s", "'", ".'", "&&&", "|>", ".,\u0338", "\u0301", "7."]
    words = [c + e for c in cores for e in ends]
    texts = [" ".join(rng.permutation(words)) for _ in range(3)] + ["done<|endoftext|> end.", "<|ENDOFTEXT|>", None]
    for ask in (texts, texts[:3], texts[3:]):
        for text, ids in zip(ask, packing.token_ids(known, ask)):
            assert np.frombuffer(ids, f"<u{known.width}").tolist() == known.encode(text or "").tolist() + [packing.END]


def test_line_dedup(spark, no_docs):
    rows = line_rows()
    df = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({c: F.lit(1) for c in ("d", "t", "line", "sim", "key", "dropped_lines")})
    got = line_dedup.line_dedup(df).collect()
    gone, have, code = plain_lines(rows)
    by = {(i if i is not None else -(2**63), code(t) if t else 0): i for i, t, *_ in rows}
    assert Counter((r["doc_id"], r["n_lines"], tuple(r["dropped_lines"])) for r in got) == Counter((i, have[d], tuple(gone[d])) for d, i in by.items())
    assert sum(r["n_dropped"] for r in got) > 25
    made = {r["doc_id"]: r for r in line_dedup.apply_line_dedup(df).collect()}
    for i, t, *_ in rows:
        d = (i if i is not None else -(2**63), code(t) if t else 0)
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d])
        if have[d] and len(gone[d]) == have[d]:
            assert i not in made
        else:
            assert made[i]["text"] == left
    assert line_dedup.line_dedup(no_docs).count() == 0 and line_dedup.apply_line_dedup(df).columns == df.columns


def test_edit_distance_counts_words_that_share_a_letter(spark, monkeypatch):
    """With few letters nearly all words share one: pairs are then compared by the places of their words, and none is let through."""
    from graphloom.llm import line_dedup

    rng = np.random.default_rng(2)
    rows = []
    for k in range(200):
        a = rng.choice([f"w{j}" for j in range(40)], 15).tolist()
        b = [str(rng.choice(["x", "y", w])) for w in a]
        rows.append((2 * k, 2 * k + 1, " ".join(a), " ".join(b)))
    pairs = spark.createDataFrame(rows, "a long, b long, norm_a string, norm_b string")
    want = {(a, b) for a, b, x, y in rows if distance(x.split(" "), y.split(" ")) <= 3}
    for letters in (3, 1_000_000):
        monkeypatch.setattr(line_dedup, "LETTERS", letters)
        assert {tuple(r) for r in line_dedup.similar(pairs).collect()} == want


def test_lines_of_repeated_rows_without_id(spark):
    """One row keeps a line that only equal rows hold; the others lose all; null and empty texts have no lines; a very long line is read whole."""
    from graphloom.llm import line_dedup

    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (3, None), (3, None), (4, ""), (5, long), (6, long + " end"), (7, "A\tb  c d\x0ce f g h")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_lines"], tuple(r["dropped_lines"])) for r in got) == Counter([(None, 1, ()), (None, 1, (0,)), (3, 0, ()), (3, 0, ()), (4, 0, ()), (5, 1, ()), (6, 1, (0,)), (7, 1, (0,))])


def test_line_dedup_finds_every_pair_within_the_edit_limit(spark):
    """Against all pairs by edit distance alone: replaced, added and removed words in short and long lines, some of few words that repeat."""
    rng = np.random.default_rng(11)
    lines = []
    for k in range(60):
        vocabulary = [f"u{j}" for j in range([4, 30, 2000][k % 3])]
        base = rng.choice(vocabulary, int(rng.integers(4, 45))).tolist()
        lines.append(base)
        for _ in range(4):
            own = list(base)
            for _ in range(int(rng.integers(1, len(base) // 4 + 2))):
                at = int(rng.integers(len(own)))
                kind = rng.integers(3)
                own[at : at + (kind != 0)] = [str(rng.choice(vocabulary))] * int(kind != 1)
            lines.append(own or base)
    rng.shuffle(lines)
    lines = [x.split(" ") for x in dict.fromkeys(" ".join(x) for x in lines)]
    u = Union()
    for a, x in enumerate(lines):
        u.find(a)
        for b, y in enumerate(lines[:a]):
            if distance(x, y) <= max(len(x), len(y)) // 5:
                u.join(a, b)
    want = {k for k in range(len(lines)) if u.find(k) == k}
    df = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(lines)], "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in line_dedup.line_dedup(df).where("n_dropped = 0").collect()} == want


def test_lines_that_share_a_passage_only_are_not_paired(spark):
    """40 lines of one long passage and 12 words of their own each (10 edits allowed) make no pair; every linked pair is made, once."""
    rng = np.random.default_rng(5)
    passage = [f"p{j}" for j in range(40)]
    lines = [[f"own{k}x{j}" for j in range(12)] + passage for k in range(40)]
    near = rng.choice([f"v{j}" for j in range(50)], 30).tolist()
    for _ in range(8):
        own = list(near)
        for at in rng.choice(30, 4, replace=False):
            own[at] = f"v{rng.integers(50)}"
        lines.append(own)
    texts = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(lines)], "line long, norm string").repartition(3)
    open_ = texts.select("line", F.col("line").alias("component"))
    got = Counter((r["a"], r["b"]) for r in line_dedup.open_pairs(texts, open_, line_dedup.word_signs(texts), 0.2).collect())
    linked = {(a, b) for b, y in enumerate(lines) for a, x in enumerate(lines[:b]) if distance(x, y) <= max(len(x), len(y)) // 5}
    assert linked and linked <= set(got) and set(got.values()) == {1}
    assert all(a >= 40 for a, _ in got)


def test_lines_of_small_keys_are_paired_at_the_key(spark):
    """Every linked pair of different groups that shares a key, once, and no pair of one group; such lines were all dealt by their words before."""
    rng = np.random.default_rng(17)
    vocabulary = [f"u{j}" for j in range(25)]
    lines = [rng.choice(vocabulary, int(rng.integers(6, 14))).tolist() for _ in range(60)]
    lines += [[str(rng.choice(vocabulary)) if j == at else w for j, w in enumerate(x)] for x in lines for at in rng.choice(len(x), 2)]
    texts = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(lines)], "line long, norm string").repartition(3)
    code = {w: i for i, w in enumerate(vocabulary)}
    keys = [{code[a] * 100 + code[b] for a, b in zip(x, x[1:])} for x in lines]
    group = lambda k: k % 7
    rows = spark.createDataFrame([(key, k, len(x), group(k)) for k, x in enumerate(lines) for key in keys[k]], "key long, line long, n int, component long")
    got = Counter((r["a"], r["b"]) for r in line_dedup.key_pairs(rows, line_dedup.word_signs(texts), 0.2).collect())
    want = {(a, b) for b, y in enumerate(lines) for a, x in enumerate(lines[:b]) if group(a) != group(b) and keys[a] & keys[b] and distance(x, y) <= max(len(x), len(y)) // 5}
    assert len(want) > 60 and want <= set(got) and set(got.values()) == {1} and all(group(a) != group(b) for a, b in got)


CAT = "The cat is on the roof of the house and it looks at the moon."
GATTO = "Il gatto guarda la luna che sorge lenta sopra i campi mentre tutti dormono."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><p>{CAT}</p><article class='comment-body'><p>{CAT}</p></article></article>", CAT),
        (f"<article><p>{CAT}</p></article><article class='comment'><p>{CAT} {CAT} {CAT}</p></article>", CAT),
        (f"<article><p>{CAT}</p></article><div class='reviews'><p>{CAT} {CAT}</p></div>", CAT),
        (f"<article><p>{CAT}</p></article><div class='x'><p>{CAT} {CAT}</p></div>", CAT),
        (f"<article><p>{CAT}</p><div class='related'><p>{CAT}</p></div><form-x class='login form'>a</form-x></article>", f"{CAT} a"),
        (f"<article><p>{CAT}</p><div class='login form'><p>{CAT}</p></div><p class='share-price'>{CAT}</p></article>", f"{CAT} {CAT}"),
        (f"<div class='siteFooter'>{CAT}</div><p>{CAT}</p><div id=cookieBanner>{CAT}</div>", CAT),
        (f"<p hidden>{CAT}</p><p style='color: red; display:none'>{CAT}</p><p aria-hidden=true>{CAT}</p><p title='hidden display:none'>{CAT}</p>", CAT),
        (f"<div><p>{GATTO}</p><p>{GATTO}</p></div><nav>{GATTO}</nav><p><a href=x>{GATTO}</a></p>", f"{GATTO} {GATTO}"),
        ("<body><p>Hello world</p></body>", "Hello world"),
        (f"<article><p>{CAT}</p><p><a href=x>{CAT}</a></p></article>", f"{CAT} {CAT}"),
    ],
)
def test_html_marks_and_pages_without_stop_words(page, want):
    assert html_extract.main_text(page) == want


#: Two paragraphs each; the last two languages share no word with the stop words.
SPOKEN = {
    "en": "The wind came over the hills and it was cold in all of the rooms of the old house.",
    "de": "Der Wind kam über die Berge und es war kalt in allen Zimmern von dem alten Haus.",
    "fr": "Le vent est venu sur les collines et il fait froid dans toutes les chambres de la maison.",
    "es": "El viento bajó por las colinas y era una noche muy fría en todas las casas del pueblo.",
    "it": "Vento freddo scende dalle colline mentre nessuno nelle case riesce ancora a dormire bene stanotte.",
    "pl": "Zimny wiatr wieje znad gór, dlatego wszyscy mieszkańcy siedzą dzisiaj wieczorem cicho przy piecach.",
    "fi": "Kylmä tuuli puhaltaa vuorilta, joten kaikki kylän asukkaat istuvat tänään hiljaa uuniensa ääressä.",
}
PARTS = {"nav": "<nav><a href=a>{0}</a></nav>", "footer": "<footer>{0}</footer>", "aside": "<aside><p>{0}</p></aside>", "ad": "<div class='ad-slot'><p>{0}</p></div>", "form": "<form><label>{0}</label></form>", "comments": "<section id=comments><article class=comment><p>{0}</p></article></section>"}
PARTS |= {"links": "<ul><li><a href=a>One two</a></li><li><a href=b>Three</a></li></ul>", "script": "<script>var a = '<p>{0}</p>';</script>", "hidden": "<div hidden>{0}</div>", "notice": "<div class=cookieNotice>{0}</div>"}


def test_html_pages_built_from_known_parts():
    """Random pages of seven languages: paragraphs in an article, a main, or a div, among boilerplate before, between and after."""
    rng = random.Random(12)
    hit = found = wanted = 0
    for _ in range(600):
        own = rng.choice(list(SPOKEN.values())).split()
        sentence = lambda own=own: " ".join(rng.sample(own, len(own)))
        text = [sentence() for _ in range(rng.randint(1, 5))]
        boiler = lambda k, sentence=sentence: "".join(PARTS[p].format(sentence()) for p in rng.sample(list(PARTS), k))
        holder = rng.choice(["article", "main", "div"])
        body = boiler(rng.randint(0, 2)).join(f"<p>{t}</p>" for t in text) if holder != "div" else "".join(f"<p>{t}</p>" for t in text)
        got = html_extract.main_text(f"<html><body>{boiler(3)}<{holder}>{body}</{holder}>{boiler(3)}</body></html>").split()
        want = " ".join(text).split()
        hit += sum((Counter(got) & Counter(want)).values())
        found, wanted = found + len(got), wanted + len(want)
    assert hit / found >= 0.98 and hit / wanted >= 0.98


def test_numerals_are_no_letters(spark):
    """A text of digits, fractions and Roman numeral signs has no language."""
    rows = [(i, f"{SPOKEN['en' if i % 2 else 'de']} {i}", "en" if i % 2 else "de") for i in range(12)] + [(100, "\u00b2 \u00bd \u2167 12 _ \u0663", "en"), (101, "\u2167 a", "en")]
    got = {r["doc_id"]: r["lang_pred"] for r in lang_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100] == "und" and got[101] != "und"


def test_word_ranks_count_every_text(spark):
    """One text in eight was counted, so a word's rank hung on which texts it stood in."""
    docs = spark.createDataFrame([(i, f"w{i} the the the the") for i in range(40)], "doc_id long, text string")
    ranks = line_dedup.word_ranks(docs)
    words = docs.select(F.explode(F.split("text", " ")).alias("w")).distinct()
    got = {r["w"]: r["k"] for r in words.select("w", F.shiftrightunsigned(line_dedup._rank(ranks, F.xxhash64("w")), line_dedup.RANK_AT).alias("k")).collect()}
    assert got.pop("the") == round(2 * math.log2(160)) and len(got) == 40
