"""What is specific to one shop: host, ids, zone and markup selectors."""

from __future__ import annotations

from dataclasses import dataclass, field

# Class names and id prefixes of the shop software's public listing templates.
CARD_FIELDS = {
    "title": "a.product-title",
    "url": "a.product-title[href]@href",
    "source_id": 'input[name$="[product_id]"]@value',
    "price": '[id^="sec_discounted_price_"]@-sup',
    "price_cents": '[id^="sec_discounted_price_"] sup',
    "old_price": '[id^="sec_list_price_"]@-sup',
    "old_price_cents": '[id^="sec_list_price_"] sup',
    "discount": '[id^="line_discount_value_"]',
    "sku": '[id^="product_code_"] .ty-control-group__item',
    "image": ".ut2-gl__image img.ty-pict|.product_icon_lnk img@data-src,src,data-srcset,srcset",
    "in_stock": ".ty-qty-in-stock",
    "out_of_stock": ".ty-qty-out-of-stock",
    "restricted": ".ty-age-verification__block",
    "no_price": ".ty-no-price",
    "weight_kg": ".wp-product-pricing|[data-wp-price-kg]@data-wp-price-kg",
    "weight_step": ".wp-product-pricing|[data-wp-price-kg]@data-wp-price-step",
    "weight_grams": ".wp-product-pricing|[data-wp-price-kg]@data-wp-step-g",
    "weight_label": ".wp-step-label|.wp-price-per-kg",
    "old_unit": ".wp-old-price-unit",
}
# The campaign listing's markup puts the same facts under other id prefixes.
CAMPAIGN_FALLBACKS = {
    "price": '[id^="line_discounted_price_"]@-sup',
    "price_cents": '[id^="line_discounted_price_"] sup',
    "old_price": '[id^="line_list_price_"]@-sup',
    "old_price_cents": '[id^="line_list_price_"] sup',
    "discount": '[id^="line_discount_update_"]',
}


@dataclass(frozen=True)
class ShopProfile:
    host: str = "shop.example"
    id_prefix: str = "shop:"
    zone: str = "Europe/Chisinau"
    card: str = ".ut2-gl__item"
    campaign_container: str = "#promotions_view_pagination_contents"
    page_restricted: str = ".ty-age-verification__txt"
    detail_restricted: str = ".ty-age-verification__txt|.ty-age-verification__block"
    empty_list: str = ".ty-no-items"
    next_link: str = 'link[rel="next"]|a[rel="next"]|a.ty-pagination__next:not(.disabled)@href'
    load_more: str = "[data-ut2-load-more-url]@data-ut2-load-more-url"
    category_group: str = ".ab-lc-group"
    category_head: str = ".head a[href]"
    category_link: str = "ul a[href]"
    campaign_title: str = "div.under__title"
    campaign_link: str = "a.title__goto[href]"
    period_phrase: str = "oferta valabila in perioada"
    promotion_form: str = '#promotions_view_pagination_contents input[name="redirect_url"]@value'
    stock_wrapper: str = ".ty-warehouses-shipping__wrapper"
    stock_place: str = ".ty-warehouses-shipping__wrapper .ty-warehouses__geolocation__location"
    stock_item: str = ".ty-warehouses-shipping__item"
    stock_label: str = ".ty-warehouses-shipping__label"
    stock_value: str = ".ty-warehouses-shipping__value"
    card_fields: dict = field(default_factory=lambda: dict(CARD_FIELDS))

    @property
    def base(self) -> str:
        return f"https://{self.host}/"
