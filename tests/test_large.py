"""What keeps stored keys, slices, files, words and documents from growing in one place."""

from caselake.catalog import raw
from caselake.model import ID, CanonicalField, CanonicalType, Model, Role
from caselake.operators.assemble import Assembly, Follow, assemble, submission_batches
from caselake.operators.buckets import Buckets
from caselake.operators.search import TokenIndex
from caselake.operators.store import Tables
from caselake.sources.envelopes import shares, slice_records


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def keys(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], f"{ID} string")


def test_missing_keys_are_found_without_a_broadcast(spark, folder):
    b = Buckets(Tables(spark, folder + "/s"), 4)
    b.publish([b.replace("Person", keys(spark, *[f"P{i}" for i in range(50)]), ID)])
    gone = b.missing(keys(spark, "P3", "X1", "N1"), "Person", ID, keys(spark, "N1"))
    assert [r[ID] for r in gone.collect()] == ["X1"] and "BroadcastHashJoin" not in plan(gone)


def topic(spark, *rows):
    return spark.createDataFrame(rows, "topic string, partition int, offset bigint, value string")


def test_a_slice_is_a_filter_and_keeps_its_turns(spark):
    rows = topic(spark, *[("t", p, o, f"{p}/{o}") for p, n in ((0, 7), (1, 2), (2, 5)) for o in range(10, 10 + n)])
    taken = slice_records(rows, {}, 9)
    assert "TakeOrdered" not in plan(taken) and "GlobalLimit" not in plan(taken)
    assert sorted(r["value"] for r in taken.collect()) == sorted(["0/10", "0/11", "0/12", "0/13", "1/10", "1/11", "2/10", "2/11", "2/12"])
    rest = slice_records(rows, {("t", 0): 13, ("t", 1): 11, ("t", 2): 12}, 100)
    assert sorted(r["value"] for r in rest.collect()) == ["0/14", "0/15", "0/16", "2/13", "2/14"]


def test_a_slice_cuts_among_equal_offsets_and_takes_null_places(spark):
    rows = topic(spark, ("t", 0, 1, "a"), ("t", 0, 2, "b"), ("t", 0, 2, "b"), ("t", 0, 2, "b"), ("t", None, None, "n"), ("t", None, 4, "m"))
    assert sorted(r["value"] for r in slice_records(rows, None, 5).collect()) == ["a", "b", "b", "m", "n"]
    assert [r["value"] for r in slice_records(rows, None, 1).collect()] == ["n"]
    assert slice_records(rows, None, 0).count() == 0


def test_shares_are_dealt_in_turns():
    assert shares({("t", 0): 7, ("t", 1): 2, ("t", 2): 5}, 9) == {("t", 0): 4, ("t", 1): 2, ("t", 2): 3}
    assert shares({("t", 0): 2, ("t", 1): 2}, 3) == {("t", 0): 2, ("t", 1): 1}


def test_pages_are_files_of_one_folder(spark, folder, monkeypatch):
    spark.createDataFrame([(1, "<p>a</p>"), (2, None), (3, "x\ny"), (4, "twice"), (4, "twice")], "page_id bigint, html string") \
        .coalesce(1).write.parquet(folder + "/pages.parquet")
    monkeypatch.setattr(raw, "scratch_path", lambda *_: folder + "/files")
    found = sorted(r["bytes"] for r in raw.s2_whole_files(spark, folder).collect())
    assert found == [1, 4, 9, 12]
    assert not list(__import__("pathlib").Path(folder, "files").glob("page_id=*"))


def test_words_are_compared_in_their_document(spark, folder):
    index = TokenIndex(Buckets(Tables(spark, folder + "/w"), 4), "words")
    texts = lambda *rows: spark.createDataFrame(rows, f"{ID} string, text string")
    fresh = index.changes(None, texts(("a", "one two two"), ("b", None)))
    assert sorted((r["token"], r[ID], r["live"]) for r in fresh.collect()) == [("one", "a", True), ("two", "a", True)]
    assert "Exchange" not in plan(fresh)
    later = index.changes(texts(("a", "one two"), ("c", "old")), texts(("a", "two three"), ("b", "b")))
    assert sorted((r["token"], r[ID], r["live"]) for r in later.collect()) == [
        ("b", "b", True), ("old", "c", False), ("one", "a", False), ("three", "a", True)]
    assert "HashAggregate" not in plan(later)


SHOP, SALE = CanonicalType("Shop", "entity", (CanonicalField("name"),)), CanonicalType("Sale", "entity", (CanonicalField("status"),))
SOLD = CanonicalType("ShopSale", "association", (CanonicalField("code"),), (Role("shop", "Shop"), Role("sale", "Sale")))
ITEM = CanonicalType("Item", "entity", (CanonicalField("name"),))
HAS = CanonicalType("SaleItem", "association", (), (Role("sale", "Sale"), Role("item", "Item")))


def documents(spark):
    t = lambda shape, *rows: spark.createDataFrame(rows, f"{ID} string, " + shape)
    ref = "struct<typeName:string,id:string>"
    tables = {"Shop": t("name string", ("s1", "One"), ("s2", "Two"), ("s3", "Three")), "Sale": t("status string", ("a", "O"), ("b", "F")),
              "ShopSale": t(f"code string, shop {ref}, sale {ref}", ("l2", "c", ("Shop", "s1"), ("Sale", "b")), ("l1", None, ("Shop", "s1"), ("Sale", "a")),
                            ("l3", "d", ("Shop", "s2"), ("Sale", "a"))),
              "Item": t("name string", ("i", "thing")), "SaleItem": t(f"sale {ref}, item {ref}", ("h", ("Sale", "a"), ("Item", "i")))}
    spec = Assembly("Shop", (Follow("ShopSale", "sale", "sales", (Follow("SaleItem", "item", "items"),)),))
    return assemble(spec, tables, Model.of(SHOP, SALE, SOLD, ITEM, HAS), merged=True)


def test_only_what_differs_moves_to_the_anchor(spark):
    made = documents(spark)
    text = {r[ID]: r["document"] for r in made.json().collect()}
    item = '{"type":"Item","canonicalId":"i","fields":{"name":"thing"},"via":{"type":"SaleItem","canonicalId":"h"}}'
    assert text["s1"] == ('{"type":"Shop","canonicalId":"s1","fields":{"name":"One"},"elements":{"sales":['
        '{"type":"Sale","canonicalId":"a","fields":{"status":"O"},"via":{"type":"ShopSale","canonicalId":"l1"},"elements":{"items":[' + item + ']}},'
        '{"type":"Sale","canonicalId":"b","fields":{"status":"F"},"via":{"type":"ShopSale","canonicalId":"l2","fields":{"code":"c"}},"elements":{"items":[]}}]}}')
    gathered = [line for line in plan(made.documents).splitlines() if "collect_list" in line and "partial" in line]
    assert gathered and not any("ShopSale" in line or "SaleItem" in line for line in gathered)


def test_a_document_moves_once_to_its_batch(spark):
    made = documents(spark).documents
    for ids in (None, made.select(ID)):
        got = submission_batches(made, "x", "1", "town", 2, ids=ids)
        assert not any("rangepartitioning" in line and "document" in line for line in plan(got).splitlines())
        rows = sorted(got.collect())
        assert [(r["batch_id"], r["documents"], r["document_ids"]) for r in rows] == [("0" * 12, 2, ["s1", "s2"]), ("0" * 11 + "1", 1, ["s3"])]
        s3 = '{"type":"Shop","canonicalId":"s3","fields":{"name":"Three"},"elements":{"sales":[]}}'
        assert rows[1]["body"] == '{"exchange":"x","exchangeVersion":"1","sourceId":"town","synthetic":false,"documents":[' + s3 + "]}"


def test_equal_and_null_identities_are_numbered_like_rows(spark):
    rows = spark.createDataFrame([(i, (i,)) for i in ("a", "a", "b", None, "c")], f"{ID} string, document struct<k:string>")
    for ids in (None, rows.select(ID)):
        got = {r["batch_id"][-1]: r["documents"] for r in submission_batches(rows, "x", "1", "town", 2, ids=ids).collect()}
        assert got == {"0": 2, "1": 2, "2": 1}
