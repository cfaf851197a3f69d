"""Shared session and a small hand-written repository."""

from __future__ import annotations

import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wayfind.session import build_session  # noqa: E402
from wayfind.sources.config import Settings  # noqa: E402
from wayfind.sources.index import build_index  # noqa: E402
from wayfind.sources.profile import TableProfile  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "wayfind-tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


ORDER_SERVICE = """namespace Shop;

public sealed class OrderService
{
    private readonly Clock clock;

    public async Task<int> PlaceOrderAsync(int id)
    {
        return await Save(id);
    }

    private int RefundPayment(string reason)
    {
        return 1;
    }
}
"""
CART_PAGE = """import { placeOrder } from "../api/orders";

export type CartState = "open" | "closed";

export const CartPage = () => {
  const total = useTotal();
  return placeOrder(total);
};
"""
ORDERS_API = """export const placeOrder = (id: number) => {
  return post("/orders", id);
};
export interface OrderRow { id: number }
"""
CONTROLLER = """public class OrderController
{
    public async Task<int> CreateOrder(int id)
    {
        return await service.PlaceOrderAsync(id);
    }
}
"""


def write(base: str, path: str, text: str) -> None:
    full = os.path.join(base, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w", encoding="utf-8") as handle:
        handle.write(text)


@pytest.fixture(scope="session")
def repository(tmp_path_factory) -> str:
    base = str(tmp_path_factory.mktemp("shop"))
    write(base, "backend/Services/OrderService.cs", ORDER_SERVICE)
    write(base, "backend/Controllers/OrderController.cs", CONTROLLER)
    write(base, "ui/src/pages/CartPage.tsx", CART_PAGE)
    write(base, "ui/src/api/orders.ts", ORDERS_API)
    nodes = [
        {"id": "n1", "label": "OrderService", "source_file": "backend/Services/OrderService.cs", "source_location": "L2"},
        {"id": "n2", "label": ".PlaceOrderAsync()", "source_file": "backend/Services/OrderService.cs", "source_location": "L9"},
        {"id": "n3", "label": ".RefundPayment()", "source_file": "backend/Services/OrderService.cs", "source_location": "L12"},
        {"id": "n4", "label": "OrderController", "source_file": "backend/Controllers/OrderController.cs", "source_location": "L1"},
        {"id": "n5", "label": ".CreateOrder()", "source_file": "backend/Controllers/OrderController.cs", "source_location": "L3"},
        {"id": "n6", "label": "CartPage", "source_file": "ui/src/pages/CartPage.tsx", "source_location": "L5"},
        {"id": "n7", "label": "placeOrder()", "file": "graph-out/shop/orders/raw/corpus/ui/src/api/orders.ts", "source_location": "L1"},
    ]
    links = [
        {"source": "n5", "target": "n2", "relation": "calls", "confidence": "high"},
        {"source": "n6", "target": "n7", "relation": "imports"},
        {"from": "n7", "to": "OrderController", "label": "Calls"},
        {"source": "n2", "target": "n3", "relation": "calls"},
        {"source": "n5", "target": "Unknown", "relation": "uses"},
        {"source": "n5", "target": "n2", "relation": "CALLS"},
    ]
    pack = "graph-out/shop/orders"
    write(base, f"{pack}/graph.json", json.dumps({"nodes": nodes, "links": links}))
    write(base, "graph-out/shop/broken/graph.json", "{ not json")
    write(base, "graph-out/shop/listed/graph.json", json.dumps([{"a": 1}]))
    write(base, f"{pack}/dependency-edges.enrichment.json", json.dumps([
        {"ui_file": "ui/src/pages/CartPage.tsx", "backend_controller": "backend/Controllers/OrderController.cs", "route": "/orders"},
        {"ui_file": "ui/src/pages/CartPage.tsx", "backend": ""},
    ]))
    write(base, f"{pack}/raw/source-files.txt", "- backend/Services/OrderService.cs\n- ui\\src\\pages\\CartPage.tsx\nnot a file\n- BACKEND/Services/OrderService.cs\n")
    write(base, f"{pack}/behavior/order-flow.md", "# Orders\n\n- Placing an order: the cart page calls the order controller.\n- Refund rule = payment must be settled before a refund.\n")
    write(base, "docs/guide.md", "# Guide\n\nThe shop has a cart and orders. Payments are refunded by the order service.\n")
    write(base, "docs/ignored.png", "x")
    return base


@pytest.fixture(scope="session")
def settings() -> Settings:
    return Settings(chunk_central_graph=True, dimensions=64)


@pytest.fixture(scope="session")
def profile() -> TableProfile:
    return TableProfile(
        modules={"orders": ("order", "refund", "cart"), "users": ("login", "account")},
        module_paths=[("/services/", "orders"), ("/controllers/", "orders")],
        synonyms={"refund": ("payment",)},
        noise={"frontend_support": ("api.ts",)},
    )


@pytest.fixture(scope="session")
def index(spark, repository, settings, tmp_path_factory):
    return build_index(spark, repository, str(tmp_path_factory.mktemp("index")), settings)
