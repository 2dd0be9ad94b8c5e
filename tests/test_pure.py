"""Everything that needs no Spark."""

import datetime
import uuid
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

from pagewright import coerce, cursor, naming, wire
from pagewright.errors import InvalidCursor, ModelError, QueryError, UnknownEntity
from pagewright.functions import fulltext as ft
from pagewright.functions import trigram
from pagewright.functions.stem import porter
from pagewright.model import Backend, Entity, Filter, Join, Mode, Op, Parser, Registry, Searchable, Sort, weight_label
from pagewright.plans.ranking import HybridOptions, arm_depth, resolve_single, route


@pytest.mark.parametrize("name, snake", [("OrderItem", "order_item"), ("HTTPServer", "http_server"), ("id", "id"), ("ID", "id"), ("", "")])
def test_snake_case(name, snake):
    assert naming.snake_case(name) == snake


@pytest.mark.parametrize("name, table", [("Category", "categories"), ("News", "news"), ("OrderItem", "order_items")])
def test_table_name(name, table):
    assert naming.table_name(name) == table


@pytest.mark.parametrize("weight, label", [(2, "A"), (1.99, "B"), (1, "B"), (0.5, "C"), (0.49, "D"), (0, "D")])
def test_weight_label(weight, label):
    assert weight_label(weight) == label


@pytest.mark.parametrize(
    "text, kind, value",
    [("5", T.IntegerType(), 5), ("-7", T.LongType(), -7), ("1.50", T.DecimalType(10, 2), Decimal("1.50")), ("1e3", T.DoubleType(), 1000.0), ("TRUE", T.BooleanType(), True), (" x", T.StringType(), " x"), ("2024-01-02T03:04:05.000006", T.TimestampType(), datetime.datetime(2024, 1, 2, 3, 4, 5, 6))],
)
def test_parse(text, kind, value):
    assert coerce.parse(text, kind) == value


@pytest.mark.parametrize("text, kind", [("x", T.IntegerType()), ("1_0", T.IntegerType()), ("99999", T.ShortType()), ("yes", T.BooleanType()), ("1", T.BinaryType()), ("3000000000", T.IntegerType())])
def test_parse_rejects(text, kind):
    with pytest.raises(QueryError):
        coerce.parse(text, kind)


def test_cursor_round_trip_and_defaults():
    token = cursor.Token(2, ("a", "\x00"), ("k|1",), "f" * 16, 40)
    assert cursor.decode(cursor.encode(token)) == token
    assert "=" not in cursor.encode(token)
    assert cursor.decode(cursor.encode(cursor.Token())) == cursor.Token()


@pytest.mark.parametrize("bad", ["", " ", "a", "!!!!", "bm90anNvbg", "WzFd"])
def test_cursor_malformed(bad):
    with pytest.raises(InvalidCursor):
        cursor.decode(bad)


@given(st.lists(st.text(), min_size=1, max_size=4))
def test_composite_key_round_trip(parts):
    assert cursor.split_key(cursor.join_key(parts), len(parts)) == parts


@given(st.one_of(st.none(), st.text()))
def test_sort_value_round_trip(value):
    assert cursor.value_of(cursor.value_text(value), T.StringType()) == value


def test_sort_value_types():
    moment = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    assert cursor.value_of(cursor.value_text(moment), T.TimestampType()) == moment
    assert cursor.value_of(cursor.value_text(0.1), T.DoubleType()) == 0.1


def test_key_text():
    assert cursor.key_text(uuid.UUID(int=1)) == "0" * 31 + "1"
    with pytest.raises(QueryError):
        cursor.key_text(1.5)
    with pytest.raises(InvalidCursor):
        cursor.decode_keys(["1"], [T.LongType(), T.LongType()])


def test_fingerprint_sees_values_direction_and_backend():
    base = cursor.fingerprint("t", [Sort("a")], [Filter("b", Op.EQ, "1")], ["id"])
    others = [
        cursor.fingerprint("t", [Sort("a", True)], [Filter("b", Op.EQ, "1")], ["id"]),
        cursor.fingerprint("t", [Sort("a")], [Filter("b", Op.EQ, "2")], ["id"]),
        cursor.fingerprint("t", [Sort("a")], [Filter("b", Op.EQ, "1")], ["id"], "term"),
        cursor.fingerprint("t", [Sort("a")], [Filter("b", Op.EQ, "1")], ["id"], "", Backend.VECTOR),
    ]
    assert len({base, *others}) == 5 and all(len(x) == 16 for x in (base, *others))


def test_filters_on_the_wire():
    got = wire.parse_filters(["a:eq:1:2", "b:ISNULL", "c:notnull:x", "d:like:x", "e:eq", "", None, "f"])
    assert got == (Filter("a", Op.EQ, "1:2"), Filter("b", Op.IS_NULL), Filter("c", Op.NOT_NULL))


def test_sorts_on_the_wire():
    assert wire.parse_sorts(["a", "b:DESC", "c:down", " "]) == (Sort("a"), Sort("b", True), Sort("c"))


def test_offset_query_string():
    q = wire.offset_query("?q=blue&fields=a,b&fields=c&limit=10&sort=x:desc&filter=y:gt:3&page=2&count=false")
    assert (q.search, q.search_fields, q.limit, q.page, q.count, q.mode) == ("blue", ("a", "b", "c"), 10, 2, False, Mode.OFFSET)
    assert wire.offset_query("limit=abc&count=maybe").limit == 25 and wire.offset_query("").count


def test_limits_and_cursor_query_string():
    with pytest.raises(QueryError, match="maximum"):
        wire.offset_query("limit=101")
    with pytest.raises(QueryError, match="after, before"):
        wire.cursor_query("after=x&before=y")
    assert wire.cursor_query("before=y").backward and not wire.cursor_query("after=x").backward
    assert wire.legacy_query("page_size=5&search=x&page=1").limit == 5
    assert wire.respond(lambda: wire.offset_query("limit=1000"))[0] == 400


ITEM = Entity("items", ("id",), (Searchable("label"),))


def test_paths_and_aliases():
    order = Entity("orders", ("id",), (Searchable("customer"),), (Join("OrderItems", ITEM, many=True, foreign_key="order_id"),))
    own, joined = order.paths
    assert not own.hops and joined.hops[0].alias == "oi1" and joined.hops[0].referenced_key == "id"


def test_hop_budget():
    deep = ITEM
    for k in range(5):
        deep = Entity(f"t{k}", ("id",), (), (Join("Next", deep, foreign_key="n"),))
    assert len(deep.paths[0].hops) == 5
    with pytest.raises(ModelError, match="hop budget"):
        _ = Entity("top", ("id",), (), (Join("Next", deep, foreign_key="n"),)).paths
    with pytest.raises(ModelError, match="hop budget"):
        _ = Entity("top", ("id",), (), (Join("Next", ITEM, foreign_key="n", depth=6),)).paths


def test_model_errors():
    with pytest.raises(ModelError, match="composite"):
        _ = Entity("a", ("id",), (), (Join("B", Entity("b", ("x", "y")), foreign_key="k"),)).paths
    with pytest.raises(ModelError, match="conflicting dim"):
        _ = Entity("a", ("id",), (Searchable("x", Backend.VECTOR, dims=3), Searchable("y", Backend.VECTOR, dims=4))).vector_groups
    with pytest.raises(ModelError, match="positive"):
        _ = Entity("a", ("id",), (Searchable("x", Backend.VECTOR, dims=0),)).vector_groups
    with pytest.raises(ModelError, match="itself"):
        _ = Entity("a", ("id",), (Searchable("x", Backend.FULL_TEXT, group="g", previous_group="g"),)).text_groups
    with pytest.raises(UnknownEntity, match="register"):
        Registry(ITEM)["nothing"]


def test_routing():
    both = (Backend.TRIGRAM, Backend.VECTOR)
    assert route(both, Backend.VECTOR, "t", False) is Backend.VECTOR
    assert route(both, None, "t", True) is None
    assert route(both[:1], None, "t", False) is Backend.TRIGRAM
    for args in ((both, None, "t", False), ((), None, "t", True), (both, Backend.FULL_TEXT, "t", True)):
        with pytest.raises(QueryError):
            route(*args)
    assert resolve_single(both, None, Backend.VECTOR) is Backend.VECTOR and resolve_single(both[:1], None, None) is Backend.TRIGRAM


def test_arm_depth():
    assert arm_depth(25, 50, HybridOptions()) == 375 and arm_depth(0, 0, HybridOptions()) == 5 and arm_depth(1, 1, HybridOptions(fixed_depth=9)) == 9


def test_word_similarity_examples():
    assert trigram.word_similarity("word", "two words") == 0.8
    assert trigram.word_similarity("word", "word") == 1.0
    assert trigram.word_similarity("", "word") == 0.0 == trigram.word_similarity("word", "")


@given(st.text("abc d", min_size=1, max_size=8), st.text("abc de", max_size=40))
def test_word_similarity_is_the_best_stretch(term, text):
    wanted, grams = frozenset(trigram.trigrams(term)), trigram.trigrams(text)
    every = [len(wanted & set(grams[i:j])) / len(wanted | set(grams[i:j])) for i in range(len(grams)) for j in range(i + 1, len(grams) + 1)] if wanted else []
    best = max(every, default=0.0)
    assert trigram.best_match(wanted, grams) == pytest.approx(best)
    bounded = trigram.best_match(wanted, grams, 0.35)
    assert bounded == pytest.approx(best) if best >= 0.35 else bounded < 0.35


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("adoption", "adopt"), ("rate", "rate"), ("controlling", "control"), ("sky", "sky")])
def test_porter(word, stem):
    assert porter(word) == stem


def test_query_parsers():
    T_ = ft.Term
    assert ft.parse('"big cat" -dog or mouse') == ft.Or((ft.And((ft.Phrase((T_("big"), T_("cat")), (0, 1)), ft.Not(T_("dog")))), T_("mouse")))
    assert ft.parse("a b", Parser.PLAIN) == ft.And((T_("a"), T_("b")))
    assert ft.parse("a b", Parser.PHRASE) == ft.Phrase((T_("a"), T_("b")), (0, 1))
    assert ft.parse("(a | b) & !c:*", Parser.RAW) == ft.And((ft.Or((T_("a"), T_("b"))), ft.Not(T_("c", True))))
    assert ft.parse("a <3> b", Parser.RAW) == ft.Phrase((T_("a"), T_("b")), (0, 3))
    assert ft.parse("the of", config="english") is None and ft.parse("  ") is None
    for bad in ("a &", "(a", "& b", "a b"):
        with pytest.raises(QueryError):
            ft.parse(bad, Parser.RAW)


@given(st.text())
def test_websearch_never_raises(text):
    ft.parse(text)


def test_cover_density():
    one = ft.parse("a")
    assert ft.cover_density([("a", 1, "A"), ("a", 9, "D")], one) == pytest.approx(1.1)
    both = ft.parse("a b")
    near, far = [("a", 1, "D"), ("b", 2, "D")], [("a", 1, "D"), ("b", 12, "D")]
    assert ft.cover_density(near, both) == pytest.approx(0.1) and ft.cover_density(far, both) == pytest.approx(0.1 / 11)
    assert ft.cover_density([("a", 1, "D")], both) == 0.0
    assert ft.cover_density([("a", 1, "A"), ("x", 2, "A")], ft.parse("a or x")) == pytest.approx(2.0)
