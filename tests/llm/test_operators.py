"""The numbered operators against brute-force versions, on the smallest tables and on rows made to be odd."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowlens.llm import bm25, bpe, exact, html, language, license, minhash, packing, pii, shards, tokens
from tests.conftest import SMALL

tokenizers = pytest.importorskip("tokenizers")

LONG = "lorem ipsum dolor sit amet " * 9_000
ODD = [
    (1, None, "a"), (2, "", "a"), (3, "", "b"), (4, "x", None), (5, "Hello  world   \n\n\t don't 12345 <|endoftext|> \U0001f600é", "en"), (6, "a" * 40_000, "en"), (7, LONG, "en"), (8, LONG, "en"),
    (9, "mail me: a.b@c.de, +49 (30) 1234567, 10.0.0.1, 4111 1111 1111 1111", "en"), (9, "mail me: a.b@c.de, +49 (30) 1234567, 10.0.0.1, 4111 1111 1111 1111", "en"), (None, "no id", "en"), (10, "Kelvin K MIT License and mit\nLICENSE", "fr"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    # names that an operator might use for its own columns
    clash = {c: F.lit(1) for c in ("digest", "words", "base", "spans", "bucket", "node", "keys", "key", "n", "row", "place", "component", "salt", "kept", "ids")}
    return rows.withColumns(clash)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    t.no_truncation()
    t.no_padding()
    return t


def encoded(library, text):
    return library.encode(text, add_special_tokens=False).ids


def raw(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_bpe_equals_the_library(library):
    r = random.Random(1)
    coders = bpe.ForcedBoundaryCoder(bpe.default_tokenizer()), bpe.ChunkCoder(bpe.default_tokenizer())
    alphabet = list("abcdeTHE  \n\t'sdm.,!?0123456789éüßñ—“ 　́中文日本\U0001f600") + ["<|endoftext|>", "\r\n", "the", "ing"]
    for text in [*(t or "" for _, t, _ in ODD), *("".join(r.choices(alphabet, k=r.randint(0, 80))) for _ in range(1500))]:
        want = encoded(library, text)
        for coder in coders:
            assert coder.encode(text) == raw(want), text[:80]
        assert coders[0].decode(raw(want)) == library.decode(want, skip_special_tokens=False)
    words = bytes(r.choices(b"abcdefghijklmnopqrstuvwxyz", k=300))
    assert coders[0].merge(words) == list(coders[0].core(words))


def test_round_trip(odd, library):
    got = tokens.round_trip(odd).collect()
    assert len(got) == len(ODD)
    want = Counter()
    for i, t, _ in ODD:
        ids = encoded(library, t or "")
        want[i, len(ids), hashlib.sha256(raw(ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:4] for r in got) == want
    assert tokens.round_trip(odd.limit(0)).count() == 0
    assert {r.text for r in tokens.decode(tokens.encode(odd.filter("doc_id = 5"))).collect()} == {ODD[4][1]}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_personal_data(spark, odd, docs):
    r = random.Random(2)
    parts = ["a@b.c", "x.y%z@d-e.f.gh", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 30 (123) 456", "+1", ".", " ", "-", "é", "\U0001f600", "a", "0000000000000000", "_", "%"]
    made = spark.createDataFrame([(100 + k, "".join(r.choices(parts, k=12))) for k in range(400)], "doc_id long, text string")
    for frame in (made, odd.select("doc_id", "text"), docs.select("doc_id", "text")):
        source = Counter((i, t) for i, t in ((r.doc_id, r.text or "") for r in frame.collect()))
        want = Counter()
        for (i, t), n in source.items():
            found = personal(t)
            c = Counter(k for k, *_ in found)
            want[i, c["email"], c["ip"], c["card"], c["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()] += n
        got = pii.pii_digest(frame).collect()
        assert Counter(tuple(r)[:6] for r in got) == want
        for row in got:
            assert hashlib.sha256(row.spans.encode()).hexdigest() == row.base_sha256 or len(row.spans) > 0
    assert pii.pii_digest(odd.limit(0)).count() == 0
    clean = pii.redact(odd.withColumn("n_chars", F.lit(0).cast("long"))).filter("doc_id = 9").first()
    assert clean.text == "mail me: [EMAIL], [PHONE], [IP], [CARD]" and clean.n_chars == len(clean.text) and clean.base == 1


def test_many_spans_in_one_text(spark):
    text = " ".join(f"a{k}@b{k}.de or 10.0.{k % 250}.1" for k in range(10_000))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    got = pii.find_spans(frame).first()
    want = [("email", m.start(), m.end()) for m in re.finditer(r"\S+@\S+", text)] + [("ip", m.start(), m.end()) for m in re.finditer(r"10\.0\.\d+\.1", text)]
    assert [tuple(s)[:3] for s in got.base] == want and [tuple(s) for s in got.spans] == want
    assert pii.redact(frame).first().text == " ".join(["[EMAIL] or [IP]"] * 10_000) and time.time() - began < 120


def test_reliability_is_learned():
    counted = [("card", "yyyy-", 2, 500), ("card", "nn-yn", 2, 500), ("card", "n-n-n", 3, 300)]
    model = pii.train(counted)
    assert model.score("card", "yyyy-", 2) > 0.5 > model.score("card", "n-n-n", 3)


def test_shards(spark, odd, library, tmp_path):
    folder = "file://" + str(tmp_path / "shards")
    manifest = shards.write_shards(odd, folder)
    ids = {k: raw(encoded(library, t or "") + [2]) for k, (i, t, _) in enumerate(ODD)}
    got = shards.with_start(shards.scan_shards(manifest, zlib.crc32, "long", shards.pa.int64()), manifest).orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.value) for r in got) == Counter((ODD[k][0], len(v) // 4, zlib.crc32(v)) for k, v in ids.items())
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]] and [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)
    back = {r.doc_id: r.ids for r in shards.read_documents(spark, manifest, [5, 7]).collect()}
    assert {k: raw(v) for k, v in back.items()} == {5: ids[4], 7: ids[6]}
    path = manifest.first().path.removeprefix("file://")
    plain = shards.zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()
    assert len(plain) % 2 == 0 and len(plain) > 0
    data = bytearray(open(path, "rb").read())
    data[20] ^= 255
    open(path, "wb").write(bytes(data))
    reader = shards.ShardReader("file://" + path)
    with pytest.raises((ValueError, shards.zstandard.ZstdError)):
        reader.frame(0)
    assert shards.shard_digest(odd.limit(0)).count() == 0


def test_language(odd, docs):
    got = language.identify(docs).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)
    some = {r.doc_id: r.lang_pred for r in language.identify(odd).collect()}
    assert some[1] == some[2] == "und" and some[4] != "und" and len(some) == 11
    assert language.identify(odd.limit(0)).count() == 0 and language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred <> 'und'").count() == 0
    assert language.accepted(docs).count() >= 0.97 * docs.count()


def test_language_of_very_long_texts(docs):
    by_lang = defaultdict(list)
    for r in docs.orderBy("doc_id").collect():
        if r.text:
            by_lang[r.lang].append(r.text)
    judge = language.Judge({lang: language.only_letters(" ".join(found[::2]))[: language.DICTIONARY_BYTES] for lang, found in by_lang.items()})
    r = random.Random(4)
    for lang, found in by_lang.items():
        words = " ".join(found[1::2]).split()
        parts = [" ".join(r.choices(words, k=4_000)) for _ in range(120)]
        judged = [judge(p) for p in parts[:10]]
        assert all(j[0] == lang and j[2] >= 0.01 for j in judged)
        # new word orders, and one text over and over
        for long in (" ".join(parts), " ".join([parts[0]] * 120)):
            found_lang, _, margin, rejected = judge(long)
            assert found_lang == lang and not rejected and margin >= 0.7 * min(j[2] for j in judged)


def test_language_against_brute_force(docs, texts):
    dictionaries, limits = language.fit_judge(docs, ~language.held_out(F.col("doc_id")))
    assert dictionaries == language.fit(docs, ~language.held_out(F.col("doc_id"))) and list(dictionaries) and all(len(d) <= language.DICTIONARY_BYTES for d in dictionaries.values())
    how = language.zstandard.ZstdCompressionParameters.from_level(language.LEVEL, dict_size=max(map(len, dictionaries.values())), write_content_size=0, write_dict_id=0)
    for r in language.identify(docs).collect():
        text = re.sub(r"[\W\d_]+", " ", texts[r.doc_id].lower()).encode()
        if not re.search(r"[^\W\d_]", texts[r.doc_id]):
            assert r.lang_pred == "und" and r.rejected
            continue
        n = math.ceil(len(text) / language.PIECE_BYTES)
        sizes = {}
        for lang, content in dictionaries.items():
            held = language.zstandard.ZstdCompressionDict(content, dict_type=language.zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=how)
            packer = language.zstandard.ZstdCompressor(dict_data=held, compression_params=how)
            sizes[lang] = sum(len(packer.compress(text[len(text) * k // n : len(text) * (k + 1) // n])) for k in range(n))
        best, second = sorted(sizes.values())[:2]
        # ties: the language that more training rows have, which comes first
        assert r.lang_pred == min(sizes, key=sizes.get) and r.margin == (second - best) / second
        plain = sum(len(language.zstandard.ZstdCompressor(compression_params=how).compress(text[len(text) * k // n : len(text) * (k + 1) // n])) for k in range(n))
        power = len(text[: len(text) // n]).bit_length() - 1
        least = limits[min(limits, key=lambda p: abs(p - power))] if limits else (0, 0)
        assert r.rejected == (second == best or (plain - best) / plain < least[0] or (second - best) / max(1, plain - best) < least[1])


def test_unknown_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found, limits = language.fit_judge(docs, ~language.held_out(F.col("doc_id")))
    judge = language.Judge(found, limits)
    assert limits
    unknown = ["zzz", "qqqq xxxx wwww", "xk qj vw zz xk qj vw zz xk qj vw zz", "\u03ba\u03b1\u03bb\u03b7\u03bc\u03ad\u03c1\u03b1", "\u6211\u4eec\u4eca\u5929\u53bb\u5b66\u6821"]
    r = random.Random(8)
    unknown += ["".join(r.choices("bcdfghjklmnpqrstvwxz   ", k=n)) for n in (40, 200, 1_000, 5_000, 40_000)]
    unknown += ["".join(r.choices("\u0431\u0432\u0433\u0434\u0435\u0436\u0437\u0438\u043a ", k=n)) for n in (20, 200, 5_000)]
    assert all(judge(t)[3] for t in unknown)
    kept = [judge(x.text)[3] for x in docs.filter(language.held_out(F.col("doc_id")) & (F.char_length("text") > 60)).collect()]
    assert len(kept) > 150 and sum(kept) <= 0.02 * len(kept)


def test_every_language_is_learned(spark):
    rows = [(k, f"{chr(97 + k % 26) * 3}{chr(97 + k // 26)} " * 20, f"l{k}") for k in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language.fit(frame, F.lit(True))) == 100


def test_main_text(spark):
    def page(k):
        story = "".join(f"<p>Part {j} of story {k} &amp; more\n text</p>" for j in range(3))
        return f"<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav>Home | About</nav><div class='banner-{k}'>Buy now {k}</div><article><h1>Title {k}</h1>{story}</article><div class='comments'><p>reader {k}</p></div><footer>(c)</footer></body></html>"

    rows = [(k, f"https://a.example/{k}", page(k)) for k in range(20)] + [(50, None, None), (51, "odd", ""), (52, "https://b.example/x", "<p>un<b>closed <li>x" + "<div>" * 5000), (0, "https://a.example/0", page(0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("dropped", F.lit(1))
    got = {r.page_id: r for r in html.extract(df).collect()}
    for k in range(20):
        assert got[k].text == "\n".join([f"Title {k}", *(f"Part {j} of story {k} & more text" for j in range(3))]) and got[k].n_chars == len(got[k].text)
    assert got[50].text == got[51].text == "" and got[52].text.startswith("unclosed") and html.extract(df).count() == len(rows)
    assert html.extract(df.limit(0)).count() == 0


def test_main_text_of_copies(spark):
    # three of four pages are one article, and differ in a script's number only; the others share its first heading
    def page(k):
        story = k if k % 4 == 0 else "copied"
        return f"<body><script>var n={k}</script><div>All rights reserved</div><article><h2>Abstract</h2><h1>Title {story}</h1><p>Story {story}</p></article></body>"

    df = spark.createDataFrame([(k, f"https://a.example/{k}", page(k)) for k in range(400)], "page_id long, url string, html string")
    for r in html.extract(df).collect():
        story = r.page_id if r.page_id % 4 == 0 else "copied"
        assert r.text == f"Abstract\nTitle {story}\nStory {story}"


def test_main_text_keeps_whole_pages(spark):
    loop = "<script>for(i=0;i<n;i++){}</SCRIPT >"
    forms = {
        "head": (f"<html><head>{loop}</head><body><article><p>One {{k}}</p></article></body></html>", "One {k}"),
        "inside": (f"<article><p>One {{k}}</p>{loop}<p>Two {{k}}</p></article><script>a<b</script>", "One {k}\nTwo {k}"),
        "body": ("<body class='has-sidebar'><div class=sidebar>All {k}</div><article><p>One {k}</p></article></body>", "One {k}"),
        "article": ("<article class='post related'><p>One {k}</p></article><nav>Home</nav>", "One {k}"),
        "main": ("<main id=search role=main><p>One {k}</p></main>", "One {k}"),
        "layout": ("<body class='has-sidebar search-on'><div class='post'><p>One {k}</p></div><div class=sidebar><p>Menu</p></div></body>", "One {k}"),
        "named": ("<div class='sidebar-layout widget'><p>One {k}</p></div><div class=foot><p>The same</p></div>", "One {k}"),
        "unquoted": ("<p title=it's>One {k}</p><p>don't two {k}</p>", "One {k}\ndon't two {k}"),
        "holder": ("<div class='with-sidebar'><h1>Title {k}</h1><div><article><p>One {k}</p></article></div></div><div class=related>More {k}</div>", "Title {k}\nOne {k}"),
    }
    rows = [(k, f"https://{name}.example/{k}", form.replace("{k}", str(k))) for name, (form, _) in forms.items() for k in range(20)]
    for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        name = r.url.split("/")[2].split(".")[0]
        assert r.text == forms[name][1].replace("{k}", str(r.page_id)), name


def test_style_tree_against_brute_force(spark):
    r = random.Random(11)

    def page(k):
        items = "".join(f"<li>{r.choice(('Home', 'About', k))}</li>" for _ in range(r.randint(1, 3)))
        return f"<body><ul class=m{k}>{items}</ul><div class=lead>{r.choice(('Same', k))}<p>Text {k % 7}</p></div><h2>Unique {k}</h2></body>"

    made = [page(k) for k in range(40)] + [page(40)] * 3
    got = {x.path: x for x in html.importance(spark.createDataFrame([(k, "https://a.example/", h) for k, h in enumerate(made)], "page_id long, url string, html string")).collect()}

    # path -> per page of distinct content: sequence of child elements; the text of an element is a leaf below it
    style, content = defaultdict(list), defaultdict(list)
    for h in dict.fromkeys(made):
        names, texts, stack = defaultdict(list), defaultdict(list), [()]
        for close, tag, text in re.findall(r"<(/?)(\w+)[^>]*>([^<]*)", h):
            if close:
                stack.pop()
            else:
                stack.append(stack[-1] + (tag,))
                if not names[stack[-2]] or names[stack[-2]][-1] != tag:
                    names[stack[-2]].append(tag)
                names[stack[-1]] += ["|"]
            if text:
                texts[stack[-1]].append(text)
        for path in {p for p in names if p}:
            style[path].append(tuple(names[path]))
        for path, own in texts.items():
            content[path + ("#",)].append(tuple(own))

    def own(values):
        n = len(values)
        h = -sum(c / n * math.log(c / n) for c in Counter(values).values()) / math.log(n)
        return n, max(0.05, min(0.95, (n * h**12 + 4 * 0.5) / (n + 4)))

    nodes = {path: own(values) for path, values in (style | content).items()}
    sums = defaultdict(lambda: [0.0, 0.0])
    for path, (n, x) in nodes.items():
        for level in range(len(path)):
            sums[path[: len(path) - level]][0] += n * 0.5**level * x
            sums[path[: len(path) - level]][1] += n * 0.5**level
    composite = {p: a / b for p, (a, b) in sums.items()}
    want = sorted((p[-1] == "#", round(x, 6), round(composite[p], 6), round(0.8 * x + 0.2 * composite.get(p[:-1], x), 6)) for p, (_, x) in nodes.items())
    assert want == sorted((x.leaf, round(x.own, 6), round(x.composite, 6), round(x.importance, 6)) for x in got.values())


def test_comments_and_rails(spark):
    post = "<article><h1>Title {k}</h1><p>Story {k} of a day</p>{inside}</article>"
    comments = "<ol class=comment-list><li><article class=comment-body><p>Reader {k} says</p></article></li></ol>"
    forms = {
        "behind": post.replace("{inside}", "") + f"<section id=comments>{comments}</section>",
        "inside": post.replace("{inside}", f"<div class=comments>{comments}</div>"),
        "unnamed": post.replace("{inside}", "<div><article><p>Reader {k}</p></article></div>"),
        "rail": "<div id=rail><ul><li><a href=/{k}>Headline {k} of today</a></li></ul></div>" + post.replace("{inside}", ""),
        "wrapped": "<article><article><h1>Title {k}</h1><p>Story {k} of a day</p></article></article><div class=ad>Buy {k}</div>",
    }
    rows = [(k, f"https://{name}.example/{k}", f"<body>{form}</body>".replace("{k}", str(k))) for name, form in forms.items() for k in range(40)]
    for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == f"Title {r.page_id}\nStory {r.page_id} of a day", r.url


def test_the_tree_alone_removes_furniture(spark, monkeypatch):
    """Without any list of names or elements; against the articles as they were written."""
    for name in ("FURNITURE_TAGS", "FURNITURE_NAMES", "COMMENT_NAMES", "CONTENT_TAGS", "CONTENT_NAMES"):
        monkeypatch.setattr(html, name, set())
    body = "<div class=top>{menu}</div><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul><div class=text><h1>Title {k}</h1><p>Story {k}</p><p>More {k}</p></div><div class=rest><p>(c) {menu}</p></div>"
    made = [(k, "https://a.example/", body.replace("{k}", str(k)).replace("{menu}", f"Site {k % 9}")) for k in range(90)]
    contents = html.node_contents(spark.createDataFrame(made, "page_id long, url string, html string")).collect()
    assert {r.lean for r in contents} <= {0.0, -html.LINKED}
    # in the driver: the lists are emptied here only
    leaves, texts = defaultdict(list), {}
    for r in contents:
        if r.content is not None:
            leaves[r.path].append(r.content)
    kept = {p for p, v in leaves.items() if ((len(v) * (1 - sum(c * math.log(c) for c in Counter(v).values()) / len(v) / math.log(len(v))) ** 12) + 2) / (len(v) + 4) >= 0.5}
    for k, _, h in made:
        texts[k] = "\n".join(t for n, t, _ in html._Page(h).blocks if html._signed(n.leaf) in kept)
    assert texts == {k: f"Title {k}\nStory {k}\nMore {k}" for k in range(90)}


def test_pages_that_the_tree_changes(spark):
    """Of the given pages; and their texts against the articles that stand in them."""
    rows = spark.read.parquet(f"{SMALL}/pages.parquet")
    sources = {r.page_id: r.html for r in rows.collect()}
    changed = 0
    for r in html.extract(rows).collect():
        page = sources[r.page_id] or ""
        gold = re.search(r"<article>(.*?)</article>", page, re.S)
        gold = [" ".join(html.entities.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", gold[1])] if gold else []
        assert r.text == "\n".join(filter(None, gold))
        changed += html.kept_text(page) != r.text
    assert changed == len(sources)


def test_deeply_nested_pages(spark):
    deep = ["<div>" * 20_000 + "x" + "</span></ul></p>" * 20_000, "<div>" * 20_000 + "x" + "<li>a</li>" * 20_000]
    began = time.time()
    assert [len(html.kept_text(d)) for d in deep] == [1, 1 + 2 * 20_000] and time.time() - began < 20


TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_licenses(odd, docs):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for frame in (odd, docs):
        got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license.scan(frame).collect())
        want = Counter()
        for row in frame.select("doc_id", "text").collect():
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row.text or "")
            words, at, labels = WORD.findall(low), [], set()
            for phrase, label in phrases.items():
                own = phrase.split(" ")
                here = [k for k in range(len(words) - len(own) + 1) if words[k : k + len(own)] == own]
                at += here
                labels |= {label} if here else set()
            want[row.doc_id, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))] += 1
        assert got == want
    for r in license.scan(docs).collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert license.scan(odd.limit(0)).count() == 0


def labels_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.labels, r.score) for r in license.scan(rows).collect()}


def test_licenses_of_a_frequent_notice(spark):
    notice = "Licensed under CC BY-NC 4.0"
    got = labels_of(spark, [f"Text {k} of many. {notice if k % 2 else 'All is said.'}" for k in range(40)])
    assert all(labels == ("cc-by-nc" if k % 2 else "") and (score > 0) == bool(k % 2) for k, (labels, score) in got.items())
    assert set(labels_of(spark, [notice] * 3).values()) == {("cc-by-nc", 1.0)}


def test_licenses_of_several_notices(spark, docs):
    bsd, sa = "Redistribution and use in source and binary forms, with or without modification, are permitted.", "Licensed under CC BY-SA 4.0."
    mpl = "Subject to the terms of the Mozilla Public License, v. 2.0."
    stray = "hereby obtaining mozilla redistribution nc sa permitted binary granted charge forms "
    texts = [f"{bsd} {sa}", f"{bsd} {mpl} {sa}", f"{stray * 300}{sa}{stray * 300}", f"{sa} {stray}", stray, "cc by nc", "by nc 4 0 cc", "mozilla public license", "Lesser General Public License", ""]
    texts += [f"plain text number {k}" for k in range(200)] + [r.text or "" for r in docs.select("text").collect()]
    got = labels_of(spark, texts)
    for k, text in enumerate(texts):
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        want = {label for phrase, label in license.PHRASES.items() if f" {phrase} " in f" {' '.join(words)} "}
        for _, label, notice, phrases in license.TEMPLATES:
            places = [(f" {notice} ".split(f" {p} ")[0].count(" "), p.split(" ")) for p in phrases]
            if any(all(b + at >= 0 and words[b + at : b + at + len(own)] == own for at, own in places) for b in range(-license.LONGEST, len(words))):
                want.add(label)
        assert got[k][0] == ",".join(sorted(want)) and (got[k][1] > 0) == bool(want), (k, text[:80])


SCANNED = {
    "SPDX-License-Identifier: MPL-2.0": "mpl",
    "// SPDX-License-Identifier: (GPL-2.0-or-later)": "gpl",
    "# spdx-license-identifier: BSD-3-Clause": "bsd",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided": "isc",
    "granted to use, reproduce, display, distribute, execute, and transmit the Software": "boost",
    "This is free and unencumbered software released into the\npublic domain.": "unlicense",
    "* Redistributions of source code must retain the above copyright\n *    notice, this list": "bsd",
    "You should have a copy of the GNU Affero General Public License": "agpl,gpl",
    "Altered source versions must be plainly\n marked as such": "zlib",
    "If a copy of the MPL was not distributed with this\n * file": "mpl",
    "with any purpose or fee, permission to modify the public domain software is not hereby granted": "",
    "the above copyright notice, free software, source code, public license, identifier": "",
}


def test_licenses_of_full_texts(spark):
    filler = "the fee of any software in a public notice is hereby retained for source and binary use "
    texts = [f"{before}{text} {after}" for text in SCANNED for before, after in (("", ""), (filler * 40, filler), (filler, filler * 400))]
    got = labels_of(spark, texts)
    assert [got[k][0] for k in range(len(texts))] == [label for label in SCANNED.values() for _ in range(3)]
    # every template alone and in a text is told, and no key word may be missing
    whole = [filler * 3 + notice + " " + filler for _, _, notice, _ in license.TEMPLATES]
    broken = [w.replace(f" {phrases[0].split(' ')[-1]} ", " xx ") for w, (*_, phrases) in zip(whole, license.TEMPLATES)]
    got = labels_of(spark, whole + broken)
    assert all(label in got[k][0].split(",") for k, (_, label, *_) in enumerate(license.TEMPLATES))
    own = {"mit-release", "gpl-short", "zlib", "isc", "boost", "spdx-license-identifier-mpl-2-0"}
    assert all(got[len(whole) + k][0] == "" for k, (name, *_) in enumerate(license.TEMPLATES) if name in own)


def test_packing(odd, docs, library):
    for frame in (odd, docs):
        rows = packing.packed_documents(frame).collect()
        want = Counter()
        for r in frame.select("doc_id", "text").collect():
            ids = encoded(library, r.text or "") + [0]
            first = (len(ids) - 1) % 2048 + 1
            ends = range(first, len(ids) + 1, 2048)
            for k, end in enumerate(ends):
                start = max(0, end - 2048) if k else 0
                want[r.doc_id, k, start, end - start, zlib.crc32(raw(ids[start:end]))] += 1
        assert Counter(tuple(r)[:5] for r in rows) == want
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for placed in bins.values():
            at = 0
            for offset, length in sorted(placed):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(bins) <= math.ceil(sum(r.length for r in rows) / 2048) * 1.02 + 1
    assert packing.packed_documents(odd.limit(0)).count() == 0


def test_bounds():
    r = np.random.default_rng(3)
    for _ in range(200):
        x = r.integers(1, 101, r.integers(1, 40))
        bins, places, made = packing.best_fit(x, 100)
        assert packing.lower_bound(x, 100) <= made and len(set(bins)) == made
        for b in set(bins):
            own = sorted((places[i], x[i]) for i in np.flatnonzero(bins == b))
            assert sum(n for _, n in own) <= 100 and all(own[i][0] + own[i][1] == own[i + 1][0] for i in range(len(own) - 1))
    assert packing.lower_bound(np.full(10, 51), 100) == 10


def shingles(text):
    words = minhash.words_of(text)
    if not words:
        return set()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def components(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in sorted(sets.items()):
        both = Counter(j for x in s for j in where[x])
        for j, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for x in s:
            where[x].append(i)
    return {i: find(i) for i in sets}


def test_near_duplicates(spark, odd, docs, texts):
    r = random.Random(4)
    base = [f"w{r.randint(0, 5000)}" for _ in range(120)]
    made = {}
    for k in range(150):  # a group in which many pairs are not similar enough
        words = list(base)
        for _ in range(r.choice((0, 1, 2, 3, 4, 6, 9))):
            words[r.randrange(120)] = f"x{r.randint(0, 10**9)}"
        made[1000 + k] = " ".join(words)
    made |= {2000: "one two", 2001: "ONE  two", 2002: "one two three", 2003: " \t\n"}
    frame = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    for df, source in ((frame, made), (docs, texts)):
        sets = {i: shingles(t) for i, t in source.items()}
        want = components(sets)
        got = minhash.near_duplicates(df).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), c, c == i) for i, c in want.items()}
    some = minhash.near_duplicates(odd).collect()
    assert len(some) == len(ODD) and all(r.kept for r in some if r.n_shingles == 0) and {r.component_id for r in some if r.doc_id == 8} == {7}
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_exact_duplicates(odd, docs, duck):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_result(odd).collect()}
    assert {(1, 3, 3, False), (2, 3, 3, False), (3, 3, 3, True), (7, 8, 2, False), (8, 8, 2, True), (9, 9, 2, True), (None, None, 1, True)} <= got
    # one digest for all texts: contents still tell them apart
    same = exact.exact_groups(odd, digest=lambda c: F.lit(b"x")).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert {tuple(r) for r in same} == got
    assert exact.keep_exact(odd).count() == len({t or "" for _, t, _ in ODD}) and exact.keep_exact(odd).columns == odd.columns
    want = duck.execute(exact.ORACLE_SQL).df()
    have = exact.exact_result(docs).toPandas()
    keys = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, have[keys].values.tolist())) == sorted(map(tuple, want[keys].values.tolist()))
    assert exact.exact_result(odd.limit(0)).count() == 0


def brute_search(rows, queries, k):
    for t in ("", "a", "É x1,y\n", "  ", "..a..b.."):
        assert bm25.word_counts(bm25.pa.array(["x y", t, "", t])).tolist() == [2, len(TERM.findall(t.lower().encode())), 0, len(TERM.findall(t.lower().encode()))]
    docs = [(i, Counter(w.decode() for w in TERM.findall(re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (t or "").encode())))) for i, t in rows if i is not None]
    df = Counter(w for _, c in docs for w in c)
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs)
    out = {}
    for q, c in ((q, Counter(w.decode() for w in TERM.findall(re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (t or "").encode())))) for q, t in queries):
        found = []
        for i, d in docs:
            s = sum(m * math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * d[w] * 2.2 / (d[w] + 1.2 * (0.25 + 0.75 * sum(d.values()) / mean)) for w, m in c.items() if w in d)
            if round(s, 6) > 0:
                found.append((-round(s, 6), i))
        out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def test_search(spark, odd, docs, duck, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD_WORDS", 20_000)
    monkeypatch.setattr(bm25, "GROUP", 2)
    want = duck.execute(bm25.ORACLE_SQL).df().sort_values(["query_id", "rank"])
    got = bm25.every_twentieth(docs).toPandas().sort_values(["query_id", "rank"])
    keys = ["query_id", "rank", "doc_id"]
    assert got[keys].values.tolist() == want[keys].values.tolist() and np.allclose(got["score"], want["score"], atol=2e-6)
    rows = [(i, t) for i, t, _ in ODD]
    queries = spark.createDataFrame([(70, "kelvin mit license"), (71, ""), (72, "lorem"), (73, "nowhere"), (74, None), (75, "mail mail 10")], "doc_id long, text string")
    have = defaultdict(list)
    for r in bm25.search(odd, queries, k=3).orderBy("query_id", "rank").collect():
        have[r.query_id].append((r.doc_id, r.score))
    expect = {q: v for q, v in brute_search(rows, [tuple(r) for r in queries.collect()], 3).items() if v}
    assert {q: [i for i, _ in v] for q, v in have.items()} == {q: [i for i, _ in v] for q, v in expect.items()}
    assert bm25.search(odd.limit(0), queries).count() == 0


def test_packing_exchange(spark):
    r = np.random.default_rng(5)
    lengths = r.integers(200, 1400, 3_000)
    rows = [(k, 0, 0, int(n), k) for k, n in enumerate(lengths)] + [(None, 0, 0, 900, 7)] * 500
    items = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(4)
    # the rounds' pools, by hand: 70 buckets, then groups of four, then of sixteen
    got = packing.pack(items, packing.CAPACITY, bucket=50).toPandas()
    assert Counter(zip(got.doc_id.fillna(-1), got.length)) == Counter((-1 if d is None else d, n) for d, _, _, n, _ in rows)
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= packing.CAPACITY
    for _, own in got.groupby("bucket"):
        assert own["bin"].nunique() == own.bins.iloc[0] >= packing.lower_bound(own.length.to_numpy(np.int64), packing.CAPACITY) == own.bound.iloc[0]
    rounds = got.bucket.to_numpy() >> packing.ROUND_BITS
    assert set(rounds) >= {0, 1} and rounds.max() <= packing.ROUNDS
    assert (got[got.doc_id.isna()].bucket & ((1 << packing.ROUND_BITS) - 1)).nunique() > 5
    alone = packing.pack(items, packing.CAPACITY, bucket=50_000)
    whole = alone.select("bins").first().bins
    assert whole <= got.sequence_id.nunique() <= 1.02 * whole
