"""The WSGI endpoint: parse, run, serialise, problems."""

import datetime
import json
from decimal import Decimal

import pytest

from pagewright.endpoint import Endpoint, Route
from pagewright.model import Backend, Entity, Mode, Registry, Searchable
from pagewright.plans.engine import Engine, Options
from pagewright.sources.embeddings import HashEmbedding
from pagewright.sources.index import IndexStore
from pagewright.sources.tables import frames
from pagewright.wire import Limits

ITEM = Entity("items", ("id",), (Searchable("name"),), filterable={"price": frozenset()}, sortable=frozenset({"price"}))
VECTOR = Entity("items", ("id",), (Searchable("name", Backend.VECTOR, dims=4),))


@pytest.fixture(scope="module")
def app(spark, tmp_path_factory):
    rows = [(k, f"item {k}" if k else "blue widget", Decimal(k), datetime.datetime(2024, 1, 1, k), float("nan")) for k in range(8)]
    table = spark.createDataFrame(rows, "id long, name string, price decimal(10,2), made timestamp, score2 double")
    engine = Engine(spark, frames({"items": table}), Registry(ITEM), Options(default_limit=3, most_limit=5, provider=HashEmbedding(4)), IndexStore(spark, str(tmp_path_factory.mktemp("index"))))
    return Endpoint(engine, {"/items": Route(ITEM), "/walk": Route(ITEM, Mode.CURSOR), "/old/": Route(ITEM, legacy=True, limits=Limits(2, 50)), "/near": Route(VECTOR)})


def get(app, path, query="", method="GET"):
    said = {}

    def start(status, headers):
        said.update(status=int(status.split(" ")[0]), **dict(headers))

    body = b"".join(app({"REQUEST_METHOD": method, "PATH_INFO": path, "QUERY_STRING": query}, start))
    assert int(said["Content-Length"]) == len(body)
    return said["status"], json.loads(body), said["Content-Type"]


def test_offset(app):
    status, body, kind = get(app, "/items", "filter=price:gte:2&sort=price:desc&page=1")
    assert status == 200 and kind == "application/json"
    assert [i["id"] for i in body["items"]] == [4, 3, 2] and (body["limit"], body["page"], body["total"], body["has_more"], body["has_prev"]) == (3, 1, 6, False, True)
    assert body["items"][0]["price"] == "4.00" and body["items"][0]["made"] == "2024-01-01T04:00:00" and body["items"][0]["score2"] is None
    assert [i["id"] for i in get(app, "/items/", "q=widget")[1]["items"]] == [0]
    assert get(app, "/items", "count=false")[1]["total"] is None


def test_cursor(app):
    seen, token = [], ""
    while token is not None:
        status, body, _ = get(app, "/walk", f"limit=3&sort=price&after={token}")
        assert status == 200
        seen += [i["id"] for i in body["items"]]
        token = body["next_cursor"] if body["has_more"] else None
    assert seen == list(range(8))


def test_legacy(app):
    body = get(app, "/old", "search=widget&page=0")[1]
    assert set(body) == {"items", "page", "count", "total", "match_info"} and body["count"] == 2 and [i["id"] for i in body["items"]] == [0]


def test_problems(app):
    for path, query in (("/items", "limit=6"), ("/items", "filter=name:eq:x"), ("/items", "sort=made"), ("/walk", "after=x&before=y"), ("/walk", "after=broken"), ("/old", "page_size=51")):
        status, body, kind = get(app, path, query)
        assert (status, body["status"], kind) == (400, 400, "application/problem+json") and body["detail"]
    assert get(app, "/none")[0] == 404 and get(app, "/items", method="POST")[0] == 405
    assert get(app, "/near", "q=x")[0] == 503
