"""Language, decontamination, surrogates and main text."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from caselake.llm import decontam, dom, html_extract, langid, pii

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, key_id string"


@pytest.fixture(scope="module")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice(["ka", "lo", "mi", "ter", "sun", "da", "ven", "ri"]) for _ in range(rng.randint(1, 4))) for _ in range(3000)]


def fewest_edits(item, text, m):
    """For each window of m bytes the fewest edits that give a piece of the text: column by column, all windows at once."""
    windows = np.stack([np.frombuffer(item[w:w + m], np.uint8) for w in range(len(item) - m + 1)])
    steps = np.arange(m + 1)
    column = np.tile(steps, (len(windows), 1))
    best = column[:, -1].copy()
    for c in text:
        new = np.zeros_like(column)
        new[:, 1:] = np.minimum(column[:, :-1] + (windows != c), column[:, 1:] + 1)
        column = np.minimum.accumulate(new - steps, axis=1) + steps
        best = np.minimum(best, column[:, -1])
    return best


def test_alignment_equals_plain_edit_distance():
    rng = random.Random(1)
    for _ in range(200):
        item = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 20)))
        text = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 25)))
        m = rng.randint(1, len(item))
        got, want = decontam.aligned(item, text, m, m - 1, -len(item), len(text)), fewest_edits(item, text, m).min()
        assert min((e for e, _, _ in got), default=m) == want
        assert all(0 <= a <= b <= len(text) for _, a, b in got)


def edited(rng, passage, edits, upto):
    out = bytearray(passage)
    for _ in range(edits):
        at, kind = rng.randrange(min(upto, len(out))), rng.randrange(3)
        out[at:at + (kind < 2)] = b"" if kind == 1 else bytes([rng.choice(b"qxz")])
    return bytes(out)


def test_no_window_within_the_budget_is_missed():
    rng = random.Random(7)
    within = 0
    for case in range(400):
        letters = b"abcdefghijklmnop " if case % 3 else b"ab "
        item, before, after = (bytes(rng.choice(letters) for _ in range(n)) for n in (rng.choice([30, 60, 80, 90, 150, 300]), rng.randint(0, 100), rng.randint(0, 100)))
        m = min(decontam.WINDOW, len(item))
        k, w = decontam.edit_budget(m), rng.randrange(len(item) - m + 1)
        text = before + edited(rng, item[w:w + m], rng.randint(0, k + 2), rng.choice([12, 1000])) + after
        want = int(fewest_edits(item, text, m).min())
        got = decontam.regions([b"other", text, b""], decontam.Index([(5, item), (6, b"short")]))
        assert set(got) == ({1} if want <= k else set())
        if want <= k:
            within += 1
            assert min(e for _, _, _, e in got[1]) == want and all(i == 5 for i, _, _, _ in got[1])
    assert within > 200


def test_long_items_are_cut_into_runs_without_loss(monkeypatch):
    rng = random.Random(9)
    item = bytes(rng.choice(b"abcdefgh ") for _ in range(900))
    text = b"y" * 50 + item[:400] + b"q" + item[401:] + b"y" * 50
    for run in (decontam.RUN, 7):
        monkeypatch.setattr(decontam, "RUN", run)
        got = decontam.regions([text], decontam.Index([(1, item)]))[0]
        assert min(a for _, a, _, _ in got) == 50 and max(b for _, _, b, _ in got) == 950 and min(e for *_, e in got) == 0


def test_few_places_met_many_times_are_no_candidates():
    assert all(decontam.candidates(np.arange(n), 300, 80) == [] for n in range(decontam.needed(80)))
    assert decontam.candidates(np.arange(100, 100 + decontam.needed(80)), 300, 80) == [(40, 100)]
    item = bytes(range(97, 123)) * 2 + b" " + bytes(range(65, 91)) * 2
    assert decontam.regions([(item[:13] + b"q") * 9], decontam.Index([(1, item)])) == {}


def test_places_count_in_the_text_as_it_was():
    item = "a passage of the benchmark that is long enough to be found in any text whatever"
    text = "İ" * 30 + ", " + item.upper() + "! end"
    found = decontam.regions([decontam.folded(text)], decontam.Index([(1, decontam.folded(item))]))[0]
    (_, start, end, edits), = decontam.in_text(text, found)
    assert text[start:end] == item.upper() and edits == 0


def test_blocks_hold_the_benchmark_once(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100)
    rows = [(i, "w" * (i % 70)) for i in range(60)] + [(3, "twice"), (None, "no id"), (99, None), (100, "x" * 500)]
    got = [b.value[1] for b in decontam.blocks(spark.createDataFrame(rows, "item_id long, text string").repartition(5))]
    assert sorted(r for b in got for r in b) == sorted((i, t.encode()) for i, t in rows if i is not None and t is not None)
    assert all(sum(len(t) for _, t in b) <= 100 or len(b) == 1 for b in got)


def test_passages_are_found_whatever_their_edits(spark, words):
    rng = random.Random(5)
    items = [" ".join(rng.choices(words, k=40)) for _ in range(30)] + ["short one", "", None]
    rows = []
    for i in range(200):
        body = rng.choices(words, k=120)
        if i % 4 == 0:
            body[50:50] = items[i % 30].split()
        text = " ".join(body)
        if i % 8 == 0:  # case, punctuation, white space and a few letters differ
            text = text.replace(" ", ",\n ", 60).title()
            at = text.lower().find("".join(body[55][:3]))
            text = text[:at] + "X" + text[at + 1:]
        rows.append((i, text, "en", "s", "k"))
    rows += [(900, None, None, None, None), (901, "", "en", "s", "k"), (4, rows[4][1], "en", "s", "k"), (902, "z " * 200_000 + items[0], "en", "s", "k")]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontam.matches(docs, bench).collect()
    assert {r.doc_id for r in found} == {i for i in range(0, 200, 4)} | {902}
    assert all(r.item_id == r.doc_id % 30 for r in found if r.doc_id < 200) and sum(r.doc_id == 4 for r in found) == 2
    assert all(decontam.folded(dict((r[0], r[1]) for r in rows)[f.doc_id][f.start:f.end])[:10] == decontam.folded(items[f.item_id])[:10]
               for f in found if f.edits == 0)
    clean = decontam.clean(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {r.doc_id for r in found}
    assert decontam.clean(docs, bench.where("false")).count() == len(rows)
    assert decontam.matches(docs.where("false"), bench).count() == 0


def test_all_exact_passages_of_the_driver_documents(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: decontam.folded(r.text) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in decontam.folded(r.text)}
    assert want and want <= {(r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect()}


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    rows = langid.document_rows(docs.where("doc_id % 2 = 1").drop("lang"))
    got = langid.identify(rows, model, ["doc_id"]).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("detected = lang AND kept").count() >= 0.99 * got.count()


def test_evidence_is_fused_as_stated(spark):
    docs = spark.createDataFrame([(i, t, l, None, None) for i, (t, l) in enumerate([("aaa bbb aab", "x"), ("bba abb aba", "y")] * 20)], DOCS)
    model = langid.fit(docs)
    same = "qqq"  # says nothing: both languages gave it the same share
    rows = [(1, same, "x", "h1.dd.xx", "dd.xx", "xx"), (2, same, None, "h1.dd.xx", "dd.xx", "xx"), (3, same, None, None, None, None), (4, None, "x", None, None, None),
            (5, "123 ...", "x", None, None, None)] + [(10 + i, "aaa bbb aab " * 3, "x", "h1.dd.xx", "dd.xx", "xx") for i in range(30)] \
        + [(50 + i, "bba abb aba " * 3, "y", "h2.ee.yy", "ee.yy", "yy") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, domain string, suffix string")
    got = {r.doc_id: r for r in langid.identify(frame, model, ["doc_id"]).collect()}
    assert got[1].detected == "x" and got[2].detected == "x" and got[1].posterior > got[2].posterior > 0.9
    assert not got[4].kept and not got[5].kept and got[4].detected is None
    assert abs(got[3].posterior - 0.5) < 0.2
    assert langid.identify(frame.where("false"), model, ["doc_id"]).count() == 0


def test_only_texts_without_a_language_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(7001, None, None, None, 0), (7002, "", "en", "s", 0), (7003, "12 34 --", "en", "src1", 0), (7004, "The only and the others", None, None, 0),
                                 (7004, "The only and the others", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = langid.known_language(docs.unionByName(odd), langid.fit(docs))
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() + 2 and kept.where("doc_id > 7000").count() == 2


def test_rare_languages_are_known(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_ROWS", 40)
    rows = [(i, f"aaa bbb aab {i}", "x", "s", "k") for i in range(3000)] + [(9000 + i, "zyz yzy zzy " * 3, "z", "s", "k") for i in range(4)]
    rows += [(None, "mmm nnn mnm", "m", "s", "k")] * 2000 + [(9900, " ", "blank", "s", "k")]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.fit(docs)
    assert model[0] == ["m", "x", "z"]
    got = langid.identify(langid.document_rows(docs.where("doc_id >= 9000 AND lang = 'z' OR doc_id IS NULL")), model, ["doc_id", "declared"])
    assert got.where("detected = declared AND text_lang = declared").count() == 2004
    assert langid.fit(docs.where("false"))[0] == ["und"]


def test_addresses_and_markup_are_read(spark):
    frame = spark.createDataFrame([("https://u@News.Site.DE:80/x", '<!doctype html><HTML class="a" lang=\'de-AT\'>'), ("nothing", None), (None, "<p>")], "url string, html string")
    host = langid.host_of(frame["url"])
    got = frame.select(host.alias("h"), langid.domain_of(host).alias("d"), langid.suffix_of(host).alias("s"), langid.declared_of(frame["html"]).alias("l")).collect()
    assert tuple(got[0]) == ("news.site.de", "site.de", "de", "de") and got[1].h is None and got[2].l is None


PRIVATE = ["mail jo.doe@Corp.example.com now", "JO.DOE@corp.example.com", "call +1 (017) 555-7713 or +1 017 555 7713", "card 4111 1111 1111 1111 x", "number 7536784127813050",
           "host 97.51.17.173 and 10.0.0.7", 'token = "b99e99e99fd999c9cf9999b99d9a9999b999d9ce"', "Frau Anna Schmidt und Herr Otto SCHMIDT", "id 123-45-6789", "Госпожа Анна Иванова"]


def test_surrogates_keep_type_layout_and_identity(spark):
    rows = [(i, t, "en", "s", "k") for i, t in enumerate(PRIVATE)] + [(50, None, None, None, None), (51, "nothing here, version 2.0.", "en", "s", "k"), (None, PRIVATE[0], "en", "s", "k"),
                                                                     (0, PRIVATE[0], "en", "s", "k"), (52, "mail ab@corp.example.com " * 3000, "en", "s", "k")]
    docs = spark.createDataFrame(rows, DOCS)
    out = pii.with_surrogates(docs, counted="n")
    assert out.columns == docs.columns + ["n"]
    got = {(r.doc_id, i): r for i, r in enumerate(out.orderBy("doc_id").collect())}
    text = {r.doc_id: r.text for r in got.values()}
    assert len(got) == len(rows) and text[50] is None and text[51] == rows[11][1]
    for i, said in enumerate(PRIVATE):
        for s, e, kind, _ in pii.find(said):
            assert said[s:e] not in text[i], (said, text[i])
    a, b = re.search(r"\S+@\S+", text[0])[0], re.search(r"\S+@\S+", text[1])[0]
    assert a.lower() == b.lower() and a.endswith(".com") and text[None] == text[0]
    one, two = text[2][5:].split(" or ")
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", one) and re.sub(r"\D", "", one) == re.sub(r"\D", "", two)
    assert pii.luhn(re.sub(r"\D", "", text[3])) and re.search(r"card 4\d{3} \d{4} \d{4} \d{4} x", text[3])
    assert pii.luhn(re.sub(r"\D", "", text[4])) == pii.luhn(re.sub(r"\D", "", PRIVATE[4]))
    assert re.fullmatch(r"host (\d+\.){3}\d+ and 10(\.\d+){3}", text[5])
    names = text[7].split()
    assert names[0] == "Frau" and names[1].endswith("a") and names[2].upper() == names[6] and names[6].isupper()
    assert pii.script_of(text[9].split()[1]) == "cyrillic"
    assert len(set(re.findall(r"\S+@\S+", text[52]))) == 1


def test_surrogates_never_collide(spark):
    entities = spark.createDataFrame([("ssn", f"{i:03d}") for i in range(300)] + [("surname-latin", f"n{i}") for i in range(400)], "kind string, canonical string")
    got = pii.surrogates(entities).collect()
    assert len(got) == 700 and len({(r.kind, r.surrogate) for r in got}) == 700
    real = {(r.kind, r.canonical) for r in got}
    assert not any((r.kind, r.surrogate) in real for r in got)
    assert {tuple(r) for r in got} == {tuple(r) for r in pii.surrogates(entities).collect()}
    assert pii.surrogates(entities.where("false")).count() == 0


def test_formats_with_few_values_go_on(spark):
    entities = [("host", f"{c}.com") for c in "abcdefghijklmnopqrstuvwxyz"] + [("secret", f"-----------{i}") for i in range(10)]
    got = pii.surrogates(spark.createDataFrame(entities, "kind string, canonical string")).collect()
    assert {(r.kind, r.canonical) for r in got} == set(entities) and len({(r.kind, r.surrogate) for r in got}) == 36
    assert not {(r.kind, r.surrogate) for r in got} & set(entities) and all(r.surrogate.endswith(".com") for r in got if r.kind == "host")
    for kind, canonical, surface in [("phone", "+1/2345678", "+1 (23) 45-678"), ("ssn", "123456789", "123-45-6789"), ("card", "4111111111111111", "4111 1111 1111 1111")]:
        for attempt in (0, pii.GROW, 2 * pii.GROW):
            new = pii.surrogate(b"k", kind, canonical, attempt)
            said = pii.written(surface, kind, new)
            assert pii.digits(said) == pii.digits(new) and len(said) == len(surface) + attempt // pii.GROW


def test_addresses_stay_addresses_in_their_range():
    for address in ["192.168.0.1", "169.254.3.4", "10.0.0.1", "127.0.0.1", "172.20.1.1", "172.32.1.1", "8.8.8.8", "01.2.3.4"]:
        for attempt in range(3 * pii.GROW):
            new = pii.surrogate(b"k", "ip", address, attempt)
            assert pii.IPV4.fullmatch(new)
            assert attempt >= pii.GROW or pii.network(new.split(".")) == pii.network(address.split("."))


def test_accounts_keep_country_layout_and_check():
    def valid(iban):
        return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1

    for account, right in [("DE89370400440532013000", True), ("GB82WEST12345698765432", True), ("DE00370400440532013000", False), ("GB13WEST12345698765432", False)]:
        assert valid(account) == right
        for attempt in range(2 * pii.GROW):
            new = pii.surrogate(b"k", "iban", account, attempt)
            assert new[:2] == account[:2] and valid(new) == right and len(new) == len(account) + attempt // pii.GROW
            assert attempt >= pii.GROW or [c.isdigit() for c in new] == [c.isdigit() for c in account]


def test_names_after_any_white_space_are_replaced(spark):
    spaces = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2003\u2009\u2028\u2029\u202f\u205f\u3000"
    rows = [(i, f"Mme{c}Curie", "fr", "s", "k") for i, c in enumerate(spaces)] + [(99, "\u212aey=abcdef123456", "en", "s", "k")]
    got = {r.doc_id: r for r in pii.with_surrogates(spark.createDataFrame(rows, DOCS), counted="n").collect()}
    assert all(got[i].n == 1 and "Curie" not in got[i].text and got[i].text[3] == c for i, c in enumerate(spaces))
    assert got[99].n == 1 and "abcdef123456" not in got[99].text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab@.cd 0123456789+()-MrsFauA:=\"'", max_size=60))
def test_the_filter_of_the_scan_misses_nothing(text):
    assert not pii.find(text) or re.search(pii.MAYBE, text)


ARTICLE = "<article><h1>T &amp; t</h1><p>One  <b>bold</b>\n two.<p>Second &lt;p&gt; <br>line&nbsp;x</p></article>"
PAGE = f"<!doctype html><html><head><title>no</title><style>p{{}}</style><script>var t='<p>no</p>'</script></head><body><nav><ul><li><a href=/a>Home</a></ul></nav>{ARTICLE}<footer>&copy; me</footer></body></html>"


def blocks(page):
    return [n.text for n in dom.parse(page) if n.text is not None]


def test_blocks_of_a_page():
    assert blocks(PAGE) == ["Home", "T & t", "One bold two.", "Second <p> line x", "© me"]
    assert blocks("<p>a<p>b<li>c<li>d") == ["a", "b", "c", "d"]
    assert blocks("<div>a<!-- <p>x</p> -->b</div>c<scr") == ["ab", "c"]
    assert blocks("1 < 2 <a href='>'>x</a> &am") == ["1 < 2 x &am"]
    assert blocks("") == []


def test_only_what_an_end_tag_closes_is_dropped():
    assert blocks("<p>a <svg class=x/>b</p><p>c") == ["a b", "c"]
    assert blocks("<p>a <svg><style/><title>no</title><path/></svg>b</p><p>c<svg><g></svg>d") == ["a b", "cd"]
    for tag in ("button", "select", "noscript", "template", "svg"):
        assert blocks(f"<{tag}><article><p>one<p>two</article>") == ["one", "two"], tag
        assert blocks(f"<div><{tag}></div><p>one</p><div><{tag}>no<p>no</{tag}>two</div>") == ["one", "two"], tag
        assert blocks(f"<p>one</p><{tag}>no<!-- </{tag}> -->no</{tag}><p>two<{tag}/><p>three") == ["one", "two", "three"], tag
    assert blocks("<button><p>one<p>two<button>no</button>") == ["one", "two"]
    assert blocks("<p>one<button>no</button>two</p>") == ["one", "two"]
    assert blocks("<noscript>no<noscript>no</noscript>no</noscript><p>one") == ["one"]


def test_decoding_is_the_best_consistent_labelling():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = 9
        nodes = [dom.Node("#root", -1, 0)] + [dom.Node("div", int(rng.integers(0, i)), 0) for i in range(1, n)]
        score = rng.normal(size=n)
        got = html_extract.decode(nodes, score)
        best = max((sum(score[i] for i in range(n) if m >> i & 1), m) for m in range(1 << n)
                   if all(not m >> i & 1 or nodes[i].parent < 0 or m >> nodes[i].parent & 1 for i in range(n)))
        assert abs(sum(s for s, k in zip(score, got) if k) - max(best[0], 0)) < 1e-9
        assert all(not k or nodes[i].parent < 0 or got[nodes[i].parent] for i, k in enumerate(got))


def test_main_text_of_pages_and_of_layouts_not_seen(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    trees = html_extract.fit(pages)
    odd = spark.createDataFrame([(-1, None, None), (-2, "u", ""), (-3, "u", PAGE), (-3, "u", PAGE), (-4, "u", PAGE.replace("</article>", "<p>word here, and more. " * 20_000 + "</article>"))], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.extract(pages.unionByName(odd), trees).collect()}
    assert len(got) == pages.count() + 4 and got[-1].text == "" and got[-2].n_chars == 0
    assert got[-3].text == "T & t\nOne bold two.\nSecond <p> line x" and got[-4].n_chars > 400_000
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        assert got[r.page_id].text == "\n".join(blocks(inner)) and got[r.page_id].n_chars == len(got[r.page_id].text)
    layouts = html_extract._Layout(random.Random(99), ["alpha", "beta.", "gamma,", "delta"] * 300)
    wrong = total = 0
    for _ in range(150):
        nodes = dom.parse(layouts.page())
        want = [x.text is not None and "\x02" in x.text for x in nodes]
        for x in nodes:
            if x.text:
                x.text = x.text.strip("\x02\x03")
        kept = html_extract.decode(nodes, trees.score(html_extract.features(nodes)))
        leaves = [i for i, x in enumerate(nodes) if x.text is not None]
        wrong, total = wrong + sum(kept[i] != want[i] for i in leaves), total + len(leaves)
    assert wrong / total < 0.05
    assert html_extract.extract(pages.where("false"), html_extract.fit(pages.where("false"))).count() == 0
