"""Fixed table schemas, as DDL. Identifiers are always text; money is decimal until the public payload."""

from __future__ import annotations

CATALOG_STATE = "generation string, version long"
CATEGORIES = (
    "id string, parent_id string, name string, level int, sort_order int, source_url string, version long"
)
PRODUCTS = (
    "id string, source_product_id string, sku string, barcode string, name string, brand string, "
    "quantity string, price decimal(12,2), old_price decimal(12,2), promo_price decimal(12,2), "
    "discount_percent decimal(6,2), promotion_state string, promotion_start timestamp, "
    "promotion_end timestamp, category_id string, product_url string, thumbnail_url string, "
    "source_image_url string, full_image_url string, in_stock boolean, possibly_inactive boolean, "
    "inactive boolean, missing_count int, created_at timestamp, updated_at timestamp, version long"
)
DOCUMENTS = "id string, data string, version long"
PROMOTION_MEMBERS = "product_id string, promotion_id string"
COLLECTION_MEMBERS = "collection_id string, product_id string"
CHANGES = "version long, kind string, entity_id string, payload string"
RUNS = (
    "id string, started_at timestamp, finished_at timestamp, status string, "
    "stats map<string,string>"
)
PENDING = (
    "id string, sku string, barcode string, status string, product_id string, data string, version long"
)
ALIASES = "barcode string, product_id string"
IMPORT_HISTORY = (
    "file_name string, imported_at timestamp, rows_read long, rows_added long, rows_updated long, "
    "rows_failed long, rows_valid long, rows_matched long, rows_pending long, rows_duplicate long, "
    "rows_conflict long, errors string"
)
SYNC_HISTORY = (
    "sync_type string, started_at timestamp, finished_at timestamp, status string, checked long, "
    "added long, updated long, unchanged long, errors long"
)

TABLES = {
    "catalog_state": CATALOG_STATE,
    "categories": CATEGORIES,
    "products": PRODUCTS,
    "promotions": DOCUMENTS,
    "special_collections": DOCUMENTS,
    "product_promotions": PROMOTION_MEMBERS,
    "special_collection_products": COLLECTION_MEMBERS,
    "product_changes": CHANGES,
    "sync_runs": RUNS,
    "pending_identifiers": PENDING,
    "product_barcodes": ALIASES,
    "import_history": IMPORT_HISTORY,
    "sync_history": SYNC_HISTORY,
}
