"""Rules over a catalog with one of everything."""

from tidemill.operators import advice, graph

SHOP = advice.SHOP.tables


def test_relationships():
    assert advice.relationships(advice.SHOP) == [
        ("order_items", "order_id", "orders", "many-to-one"), ("order_items", "product_id", "products", "many-to-one"), ("orders", "order_items", "products", "many-to-many"),
        ("orders", "user_id", "users", "many-to-one"), ("profiles", "user_id", "users", "one-to-one"), ("users", "manager_id", "users", "many-to-one"),
    ]


def test_index_suggestions():
    assert advice.index_suggestions(SHOP["users"]) == [("usersEmailKey", "email", "high", "single column"), ("idxUsersManagerId", "manager_id", "high", "foreign key"), ("idxUsersCreatedAt", "created_at", "medium", "time")]
    assert advice.index_suggestions(SHOP["products"]) == [("productsLowTitle", "", "low", "expression"), ("productsLive", "price", "medium", "partial, without its condition"), ("idxProductsKindType", "kind_type", "medium", "ordered labels")]
    assert advice.index_suggestions(SHOP["profiles"]) == [("idxProfilesUserId", "user_id", "high", "foreign key")]


def test_edge_cases(spark):
    assert advice.edge_cases(SHOP["users"]) == [("info", "manager_id", "refers to its own table")]
    assert set(advice.edge_cases(SHOP["products"])) == {
        ("warning", "", "index products_low_title is on an expression"), ("warning", "price", "over 15 digits lose some as doubles"), ("info", "photo", "bytes become base64 text"), ("warning", "", "CHECK isn't enforced: can't read: ~ '^a')"),
    }
    assert advice.edge_cases(SHOP["order_items"]) == [("info", "", "composite primary key (order_id, product_id)")]


def test_columns_with_a_role():
    assert advice.vector_fields(SHOP["products"]) == [("embedding", 384)]
    assert advice.cleanup_columns(SHOP["users"]) == {"created": "created_at"} and advice.cleanup_columns(SHOP["orders"]) == {"deleted": "deleted_at", "status": "status"}


def test_rings():
    ring = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("e", "d"), ("f", "e"), ("e", "f")]
    assert graph.cycles(ring) == [("a", "b", "c"), ("e", "f")]
    assert graph.closure(ring, "f") == set("abcdef") and graph.closure(ring, "a") == set("abc")
