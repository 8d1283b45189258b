"""Where the platforms print what: the rule table that ``page_reader`` compiles.

A rule is a list of selectors, tried in order.  ``selector@attr`` reads an attribute
(``@a|b``: the first that is there), else the text.  ``pick`` says which values count:

- ``first``: the first element of a selector, if ``accept`` is found in its value;
- ``any``:   the first element of a selector whose value passes;
- ``all``:   every value of the first selector that has one, each once;
- ``each``:  like all, repeats kept;
- ``union``: every value of every selector, each once;
- ``count``: how many elements the first selector with one has.

In a card or review ``@attr`` alone reads the block's own element.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    selectors: tuple[str, ...]
    pick: str = "first"
    accept: str = r"\S"


def rule(*selectors: str, pick: str = "first", accept: str = r"\S") -> Rule:
    return Rule(selectors, pick, accept)


LONG = r"(?s)^.{4,}"       # a title has more than three characters
SOME = r"(?s)^.{11,}"      # a description or point more than ten
SAY = r"(?s)^.{21,}"       # a summary more than twenty
DIGIT = r"\d"

# ---- fixed values: ids, classes and attributes that the platforms print ----
META_TITLE = ('meta[name="title"]@content', 'meta[property="og:title"]@content')

GENERIC: dict[str, Rule] = {
    "title": rule("h1", "title", 'meta[property="og:title"]@content', 'meta[name="title"]@content', accept=LONG),
    "description": rule('meta[name="description"]@content', 'meta[property="og:description"]@content'),
    "sale_price": rule('[itemprop="price"]@content', accept=DIGIT),
    "rating": rule('[itemprop="ratingValue"]@content', accept=DIGIT),
    "review_count": rule('[itemprop="reviewCount"]@content', accept=DIGIT),
    "brand": rule('[itemprop="brand"]@content'),
    "jsonld": rule('script[type="application/ld+json"]', pick="union"),
    "images": rule("img@data-old-hires|data-a-hires|data-src|srcset|src", pick="union"),
    "videos": rule("video source@src", "video@src", 'iframe[src*="youtube"]@src', 'iframe[src*="vimeo"]@src', pick="union"),
    "thumbnails": rule('img[src*="i.ytimg.com/vi/"]@src', 'img[src*="img.youtube.com/vi/"]@src', pick="union"),
}

FIELDS: dict[str, dict[str, Rule]] = {
    "amazon": {
        "title": rule("#productTitle", "h1#title span#productTitle", "h1#title span", "#title span#productTitle", "#title span",
                      ".product-title-word-break", ".product-title", "h1.a-size-large span", "h1 span.a-size-large",
                      '[data-feature-name="title"] h1', "#titleSection h1 span", "#titleSection h1", "span#productTitle",
                      *META_TITLE, accept=LONG),
        "description": rule("#productDescription p span, #productDescription p"),
        "sale_price": rule("#centerCol #priceblock_dealprice", "#centerCol #priceblock_ourprice",
                           "#centerCol .a-price-current .a-offscreen", "#centerCol .a-price .a-offscreen", accept=DIGIT),
        "list_price": rule("#centerCol #priceblock_listprice", "#centerCol .a-text-strike", accept=DIGIT),
        "currency": rule("#corePriceDisplay_desktop_feature_div .a-price-symbol"),
        "offers": rule(".savingsPercentage"),
        "availability": rule("#availability span", "#availability .a-color-success", "#availability .a-color-state", ".a-color-price"),
        "rating": rule(".a-icon-alt", '[data-hook="average-star-rating"] .a-icon-alt', ".a-star-medium .a-icon-alt", accept=DIGIT),
        "review_count": rule('[data-hook="total-review-count"]', "#acrCustomerReviewText", ".a-link-normal", accept=DIGIT),
        "images": rule("#landingImage, #imgTagWrapperId img, .a-dynamic-image@data-old-hires|data-a-hires|data-src|src",
                       "div#main-image-container ul.a-unordered-list li.image.item img@data-old-hires|data-a-hires|data-src|src",
                       ".imageThumb img, .a-button-thumbnail img@data-old-hires|data-a-hires|data-src|src", pick="union"),
        "brand": rule("tr.po-brand td:nth-child(2)"),
        "model_name": rule("tr.po-model_name td:nth-child(2)"),
        "color": rule("tr.po-color td:nth-child(2)"),
        "weight": rule("tr.po-item_weight td:nth-child(2)"),
        "dimensions": rule("tr.po-item_depth_width_height td:nth-child(2)"),
        "thumbnails": rule("#altImages .videoThumbnail img@src", pick="union"),
        "category": rule("#nav-subnav a", ".a-breadcrumb-text", pick="all"),
        "rank": rule("#SalesRank .value", '#productDetails_detailBullets_sections1 li:contains("Best Sellers Rank")',
                     '#detailBullets_feature_div li:contains("Best Sellers Rank")'),
        "release_date": rule('#productDetails_techSpec_section_1 tr:contains("Date First Available") td:nth-child(2)',
                             '#detailBullets_feature_div li:contains("Date First Available")',
                             '#productDetails_techSpec_section_1 tr:contains("Release date") td:nth-child(2)',
                             '#detailBullets_feature_div li:contains("Release date")'),
        "amazon_choice": rule("div.mvt-ac-badge-wrapper span.mvt-ac-badge-rectangle span.a-size-small"),
        "bestseller": rule("div.zg-bf-badge-wrapper a.badge-link span.mvt-best-seller-badge"),
        "seller": rule(".a-icon-text-fba"),
        "delivery_price": rule("#deliveryBlockMessage span[data-csa-c-delivery-price]@data-csa-c-delivery-price"),
        "delivery_date": rule("#deliveryBlockMessage span[data-csa-c-delivery-time]@data-csa-c-delivery-time"),
        "highlights": rule("#feature-bullets ul li span", pick="all", accept=SOME),
        "customers_say": rule('div[data-testid="overall-summary"] span', 'div[data-testid="overall-summary"]',
                              '[data-hook="cr-insights-widget-summary"]', ".cr-widget-ReviewsSummary", ".cr-insights-widget-summary", accept=SAY),
        "star_texts": rule('#histogramTable span[aria-hidden="true"]', pick="each", accept=r"%"),
        "countdown": rule("#dealBadge", ".deal-badge", '[data-testid="deal-badge"]', "#deal_expiry_timer", ".dealTimer", "#deal-timer",
                          ".a-size-base.a-color-price", '[id*="timer"]', '[class*="timer"]', '[class*="countdown"]', ".dealBadge",
                          'span:contains("Deal"), span:contains("offer"), span:contains("ends")'),
    },
    "flipkart": {
        "title": rule(".v1zwn21j.v1zwn26", "div.v1zwn21j.v1zwn26", '[class*="v1zwn26"]', accept=LONG),
        "description": rule(".v1zwn21k.v1zwn26", ".v1zwn21k.v1zwn26 p", "._1mXcCf li, ._3k-BhJ li, .w9jEaj", "#productDescription p",
                            ".a-expander-content p", ".aplus-v2 p", pick="union", accept=SOME),
        "sale_price": rule(".v1zwn21k.v1zwn20", '[class*="v1zwn21k"][class*="v1zwn20"]', ".Nx9bqj.CxhGGd", ".hZ3P6w.bnqy13",
                           'div[class*="v1zwn21k"][class*="v1zwn20"]', 'span[class*="Nx9bqj"]', accept=DIGIT),
        "list_price": rule(".v1zwn21l.v1zwn21", '[class*="v1zwn21l"][style*="line-through"]', 'div[style*="line-through"]',
                           'span[style*="line-through"]', ".hl05eU .yRaY8j", ".kRYCnD.yHYOcc", accept=DIGIT),
        "offers": rule(".v1zwn21z.v1zwn20", '[class*="v1zwn21z"][class*="v1zwn20"]', 'div[class*="v1zwn21"][class*="20"]', pick="all", accept=r"\d+\s?%"),
        "availability": rule("._16FRp0", "._3xgqrA", "._1fGeJ5", ".yN+eNk", accept=r"(?i)stock|available"),
        "rating": rule(".css-146c3p1", ".asbjxx .css-146c3p1", 'div[class*="rating"] span', 'span[class*="rating"]', pick="any", accept=r"^\d\.\d$"),
        "review_count": rule('a[href*="ratings-reviews"] .css-146c3p1', 'a[href*="ratings-reviews"]', ".css-146c3p1",
                             pick="any", accept=r"\|\s*[\d,]+|[\d,]+\s*Review"),
        "images": rule("div._1psv1ze36 picture img@src", pick="union"),
        "linked_skus": rule('div[data-observerid] a[href*="/p/itm"]@href', pick="union"),
        "category": rule("div.faikzn a", pick="all"),
        "seller": rule(".v1zwn21k.v1zwn25"),
        "delivery_date": rule('a[href*="delivery-page"] .v1zwn21k.v1zwn24', pick="all"),
        "delivery_price": rule("div.hVvnXm, div._3XINqE, span._3XINqE"),
        "highlights": rule("div.grid-formation", "div.iNKhRz ul li.LS5qY1", "div.xFVion ul li._7eSDEz", pick="all"),
        "star_counts": rule("ul.lpfPv5 li .MDKzf4", pick="each", accept=DIGIT),
    },
    "vijaysales": {
        "title": rule(".page-title h1", ".product-name h1", ".product-title",
                      '.productFullDetail__title .productFullDetail__productName span[role="name"]',
                      '.productFullDetail__productName span[role="name"]'),
        "description": rule(".product-description, .short-description, .product-overview", pick="all", accept=SOME),
        "sale_price": rule(".product__price--deatils:not(.d-none) [data-final-price]@data-final-price", accept=DIGIT),
        "list_price": rule(".product__price--deatils:not(.d-none) [data-mrp]@data-mrp", accept=DIGIT),
        "offers": rule(".product__price--discount-label", pick="all"),
        "in_stock": rule(".instock__text:not(.d-none)"),
        "out_of_stock": rule(".instock__text"),
        "availability": rule(".stock-status", ".availability", ".in-stock", ".out-of-stock"),
        "rating": rule(".product__title--reviews-star@data-rating-summary", accept=DIGIT),
        "review_count": rule(".product__title--stats span", accept=r"(?i)\d+\s+Review"),
        "images": rule(".thumbnail__image@data-src|src", pick="union"),
        "highlights": rule("div.product__keyfeatures ul.product__keyfeatures--list > li", pick="all"),
        "badge": rule('p.product__tags--label:not(.d-none):not([style*="display: none"])'),
        "delivery": rule("p.delivery__text"),
        "page_sku": rule("[data-product-sku]@data-product-sku", ".product-sku", ".sku-number", ".product-code"),
    },
    "reliancedigital": {
        "title": rule('h1[data-testid="product-title"]', ".pdp__product-name", ".product-title h1", ".pdp-product-name", "h1.title",
                      ".product-name", "h1"),
        "description": rule("div.product-long-description p", "div.product-long-description", pick="all"),
        "sale_price": rule(".product-price", 'span[data-testid="selling-price"]', ".selling-price", ".offer-price", ".final-price",
                           ".price-current", accept=DIGIT),
        "list_price": rule(".product-marked-price", 'span[data-testid="mrp-price"]', ".mrp-price", ".original-price", ".price-was",
                           ".strikethrough-price", accept=DIGIT),
        "offers": rule(".product-price-discount", ".product-marked-details .product-price-discount", pick="union"),
        "availability": rule('div[data-testid="stock-status"]', ".stock-status", ".availability-status", ".in-stock-message",
                             'button[data-testid="add-to-cart"]'),
        "rating": rule('span[data-testid="rating"]', ".rating-value", ".star-rating-value", ".review-rating", accept=DIGIT),
        "review_count": rule('span[data-testid="review-count"]', ".review-count", ".total-reviews", ".reviews-number", accept=DIGIT),
        "brand": rule('span[data-testid="brand"]', ".brand-name", ".product-brand", 'meta[property="product:brand"]@content'),
        "category": rule('nav[data-testid="breadcrumb"] a', ".breadcrumb a", ".category-path a", pick="all"),
        "images": rule('img[data-testid="product-image"]@data-src|src', ".pdp__product-images img@data-src|src",
                       ".product-gallery img@data-src|src", ".main-image img@data-src|src", pick="union"),
        "highlights": rule("#key_features ul.features li", pick="all"),
        "delivery": rule(".delivery-fulfilment h5.delivery-section--header", "h5.delivery-section--header"),
        "star_rows": rule(".rd-feedback-service-progress-row", pick="each"),
        "page_sku": rule("[data-product-id]@data-product-id", "[data-sku]@data-sku", ".product-code", ".sku-number", ".model-number",
                         'meta[property="product:retailer_item_id"]@content'),
    },
    "croma": {
        "title": rule('h1[data-testid="product-title"]', ".pdp-product-name", ".product-title h1", ".cp-product-name", "h1.title",
                      ".product-name", "h1.pdp-title", ".pdp-title", '[data-testid="product-title"]', ".product-details h1",
                      'h1[class*="product"]', 'h1[class*="title"]', '[itemprop="name"]', "h1"),
        "description": rule(".MuiAccordionDetails-root p", ".accordian-content p", ".overview-fixed-height p", "#overview_inner_container p",
                            ".cp-overview p", pick="all"),
        "sale_price": rule(".cp-price.main-product-price .new-price .amount", accept=DIGIT),
        "list_price": rule(".cp-price.discount .old-price .amount", accept=DIGIT),
        "offers": rule(".cp-price .dicount-value", ".outer-product-pricebox .offer-text", ".discount-info", 'div[data-testid="offers"]', pick="union"),
        "availability": rule('div[data-testid="stock-status"]', ".stock-status", ".availability-info", ".in-stock",
                             'button[data-testid="add-to-cart"]'),
        "rating": rule("div.cp-rating span:first-child", "div.cp-rating", accept=DIGIT),
        "review_count": rule("div.cp-rating span.text a.pr-review", accept=r"\d+\s+Reviews"),
        "category": rule(".cp-breadcrumb ul.list li a", pick="all"),
        "images": rule('img[data-testid^="super-zoom-img"]@data-src|src', 'img[data-testid^="galary-thumb-img"]@data-src|src',
                       ".pdp-product-image img@data-src|src", ".product-gallery img@data-src|src", ".main-image img@data-src|src", pick="union"),
        "videos": rule(".cp-product-gallery img[data-video-url]@data-video-url", ".cp-product-gallery video source@src",
                       'iframe[src*="youtube"], iframe[src*="vimeo"]@src', pick="union"),
        "highlights": rule(".key-features-box .cp-keyfeature ul li", pick="all"),
        "delivery": rule(".cp-ship-opt .del-date p.pdp-delivery-details"),
        "star_bars": rule("div.barAndStar .bar-container div, div.barAndStar-no-review .bar-container div@style", pick="each", accept=r"width:"),
        "page_sku": rule("[data-product-id]@data-product-id", "[data-sku]@data-sku", ".product-code", ".model-number", ".sku-number",
                         'meta[property="product:retailer_item_id"]@content'),
    },
    "blinkit": {
        "title": rule("h1, div.tw-text-400.tw-font-bold, div.tw-text-300.tw-font-semibold.tw-line-clamp-2"),
        "description": rule('div[data-pf="product-description"]', 'meta[name="description"]@content', "p"),
        "sale_price": rule('div.tw-text-200.tw-font-semibold, span[data-test-id="pdp-price"]', accept=DIGIT),
        "list_price": rule('div.tw-text-200.tw-font-regular.tw-line-through, span[data-test-id="pdp-mrp"]', accept=DIGIT),
        "brand": rule('span[data-test-id="pdp-brand"]'),
        "category": rule('nav[data-test-id="breadcrumb"]', 'meta[property="og:category"]@content', pick="all"),
        "images": rule('img[src][alt*="product"], div.tw-overflow-hidden img@src', pick="union"),
        "discount": rule('div.tw-text-050.tw-absolute, span[data-test-id="pdp-discount"]'),
        "rating": rule('div[data-test-id="pdp-rating"]', 'span[aria-label*="stars"]', accept=DIGIT),
        "review_count": rule('span[data-test-id="pdp-review-count"]', accept=DIGIT),
        "weight": rule('div.tw-text-200.tw-font-medium.tw-line-clamp-1, span[data-test-id="pdp-quantity"]'),
        "dimensions": rule('div[data-test-id="pdp-dimensions"]'),
        "delivery_date": rule('div.tw-text-050.tw-font-bold.tw-uppercase, span[data-test-id="pdp-delivery"]'),
        "in_stock": rule('div[data-pf="reset"]:contains("ADD"), button:contains("ADD")'),
        "offers": rule('div.tw-bg-green-050, span[data-test-id="pdp-offer"]'),
    },
    "bigbasket": {
        "title": rule('h1[data-testid="product-title"]', "h1.prod-name", "h1.product-title", ".prod-details h1", 'div[qa="product-title"] h1', "h1"),
        "description": rule('div[data-testid="product-description"]', ".description .desc-text", ".prod-details p", 'div[qa="product-description"]',
                            ".product-description", pick="all"),
        "sale_price": rule('span[data-testid="selling-price"]', ".price .discnt-price", ".prod-price .price-amt", ".final-price",
                           'span[qa="selling-price"]', "div.SellingPrice___StyledDiv-sc-1e0twzt-0", accept=DIGIT),
        "list_price": rule('span[data-testid="mrp-price"]', ".price .mrp-price", ".original-price", ".strikethrough-price",
                           'span[qa="mrp-price"]', accept=DIGIT),
        "currency": rule(".price .currency, .prod-price .currency"),
        "offers": rule('div[data-testid="offer-text"]', ".offer-text", ".discount-label", 'span[qa="offer"]'),
        "availability": rule('div[data-testid="stock-status"]', ".stock-status", ".availability-text", ".out-of-stock", 'button[qa="add-to-cart"]'),
        "rating": rule('span[data-testid="rating"]', ".rating .avg-rating", ".product-rating .stars", ".rating-stars", 'div[qa="rating"]', accept=DIGIT),
        "review_count": rule('span[data-testid="review-count"]', ".review-count", ".rating .reviews", ".total-reviews", 'div[qa="review-count"]', accept=DIGIT),
        "brand": rule('span[data-testid="brand"]', ".brand-name", ".prod-details .brand", ".product-brand", 'div[qa="brand"]'),
        "category": rule('nav[data-testid="breadcrumb"] a', ".breadcrumb a", ".category-path a", ".prod-details .category", pick="all"),
        "images": rule('img[data-testid="product-image"]@data-src|src', ".product-img img@data-src|src", ".main-image img@data-src|src",
                       'div[qa="product-image"] img@data-src|src', pick="union"),
        "weight": rule('span[data-testid="weight"]', ".prod-details .weight", ".product-specs .weight",
                       '.spec-table tr:contains("Weight") td:nth-child(2)'),
        "dimensions": rule('span[data-testid="dimensions"]', ".prod-details .dimensions", ".product-specs .dimensions",
                           '.spec-table tr:contains("Dimensions") td:nth-child(2)'),
    },
    "meesho": {
        "title": rule("h1.productTitle", 'h1[class*="title"]', "h1", '[data-testid="productTitle"]', ".productName", '[class*="productName"]', *META_TITLE),
        "description": rule(".productDescription", '[data-testid="productDescription"]', ".description", 'div[class*="description"]',
                            'p[class*="description"]'),
        "brand": rule(".brandName", '[data-testid="brandName"]', "span.brand", "a.brand"),
        "color": rule('span:contains("Color")', 'span:contains("colour")', '[data-testid="color"]', ".color-value"),
        "size": rule('span:contains("Size")', '[data-testid="size"]', ".size-value"),
        "material": rule('span:contains("Material")', '[data-testid="material"]', ".material-value"),
        "highlights": rule("ul.highlights li", ".highlights li", '[data-testid="highlights"] li', 'ul[class*="feature"] li', pick="all"),
        "images": rule("img.productImage@src|data-src", 'img[data-testid="productImage"]@src|data-src', 'img[class*="product"]@src|data-src',
                       ".gallery img@src|data-src", pick="union"),
        "category": rule(".breadcrumb a:last-child", '[data-testid="breadcrumb"] a:last-child', "nav.breadcrumb li:last-child"),
        "sale_price": rule(".salePrice", '[data-testid="salePrice"]', "span.price", ".productPrice", accept=DIGIT),
        "list_price": rule(".originalPrice", '[data-testid="originalPrice"]', "span.strikePrice", ".mrp", accept=DIGIT),
        "rating": rule(".rating", '[data-testid="rating"]', ".stars", "span.productRating", accept=DIGIT),
        "review_count": rule(".reviewCount", '[data-testid="reviewCount"]', "span.reviews", ".totalReviews", accept=DIGIT),
        "seller": rule(".sellerName", '[data-testid="sellerName"]', ".seller-info", "a.seller"),
        "seller_rating": rule(".sellerRating", '[data-testid="sellerRating"]', ".seller-rating", accept=DIGIT),
        "delivery_date": rule(".deliveryTime", '[data-testid="deliveryTime"]', ".delivery-info", 'span:contains("day")'),
        "return_policy": rule(".returnPolicy", '[data-testid="returnPolicy"]', ".policy-info", 'span:contains("return")'),
        "availability": rule(".availability", '[data-testid="availability"]', ".stock-status", 'span:contains("stock")'),
        "offers": rule(".offers li", '[data-testid="offers"] li', ".offer-badge", "span.discount", pick="all"),
    },
}

#: Specification rows: (row, label within it, value within it); an empty row: the label's parent.
SPECS: dict[str, list[tuple[str, str, str]]] = {
    "amazon": [("#productDetails_techSpec_section_1 tr", "th, td:first-child", "th ~ td, td ~ td"),
               ("#productDetails_detailBullets_sections1 tr", "th, td:first-child", "th ~ td, td ~ td")],
    "flipkart": [(".grid-formation-dynamic", ".v1zwn21l.v1zwn27", ".v1zwn21k.v1zwn26"),
                 ("table.n7infM tr, table._0ZhAN9 tr", "td:first-child", "td:nth-child(2)"),
                 ("._1s_Smc tr, ._21lJbe tr", "td:first-child", "td:nth-child(2)")],
    "vijaysales": [("", ".productspecification .panel-list-key, .accordion-item .panel-list-key", ".panel-list-value"),
                   (".product-specs tr, .specifications tr, .tech-specs tr", "td:first-child", "td:nth-child(2)")],
    "reliancedigital": [("li.specifications-list, #specification .specifications-list", "span", ".specifications-list--right ul"),
                        ("table.flix-std-specs-table tr", "th", "td")],
    "croma": [(".cp-specification-spec-info", ".cp-specification-spec-title h4", ".cp-specification-spec-details"),
              (".product-specs tr, .specifications tr, .tech-specs tr", "td:first-child", "td:nth-child(2)")],
    "blinkit": [("table tr, ul li[data-spec]", "th, strong", "td, span")],
    "bigbasket": [(".spec-table tr, .product-details-table tr", "th", "td")],
    "meesho": [('.specifications tr, [data-testid="specifications"] tr', "td:first-child, th:first-child", "td:nth-child(2), th:nth-child(2)")],
}

#: Product links of a listing page: selectors, what a link has to hold (one of them), whether the first selector with links ends the search.
LINKS: dict[str, tuple[tuple[str, ...], str, bool]] = {
    "amazon": (('div[data-cy="title-recipe"] > a', "a.a-link-normal.s-no-outline", 'div[data-cy="title-recipe"] > a.a-link-normal'),
               r"/dp/|/product/", False),
    "flipkart": (('a[href*="/p/"]', "a.k7wcnx"), r"/p/", False),
    "vijaysales": (("a.product-card__link", ".product-card__link", 'a[href^="/p/"]', 'a[data-href*="/p/"]'),
                   r"vijaysales\.com.*(/product/|/p/|/[a-zA-Z0-9\-]+\.html$)", True),
    "reliancedigital": (('a[href*="/product/"]', ".sp__product a", ".product-tile a", ".product-item a", ".pdp-link", ".product-card a",
                         'div[data-testid="product-card"] a', 'a[data-testid="product-link"]'), r"/product/|/p/", True),
    "croma": (('a[href*="/p/"]', ".product-item a", ".plp-product-tile a", ".product-tile-wrapper a", ".product-card a", ".cp-product a",
               'div[data-testid="product-card"] a', 'a[data-testid="product-link"]'), r"/p/", True),
    "bigbasket": (('a[href*="/pd/"]', 'a[qa="product"]', 'div[data-testid="product-card"] a', 'h3 a[href*="/pd/"]'), r"/pd/", True),
    "meesho": (('a[href*="/p/"]', "a.productCardImg", "a.productCardTitle", 'div[data-testid="productCard"] a', 'a[class*="product"]'), r"/p/", False),
}
SITES = {"amazon": "https://www.amazon.in", "flipkart": "https://www.flipkart.com", "vijaysales": "https://www.vijaysales.com",
         "reliancedigital": "https://www.reliancedigital.in", "croma": "https://www.croma.com", "bigbasket": "https://www.bigbasket.com",
         "meesho": "https://www.meesho.com", "blinkit": "https://blinkit.com"}
#: Links without what follows "?".
BARE_LINKS = ("reliancedigital",)

#: Cards of a search page: containers (the first that occurs), then what is read in each.
CARDS: dict[str, tuple[tuple[str, ...], dict[str, Rule]]] = {
    "amazon": (('div[data-component-type="s-search-result"]',), {"sku": rule("@data-asin"), "title": rule("h2 a span", "h2"), "href": rule("h2 a@href", "a@href")}),
    "flipkart": (("div[data-id]",), {"href": rule('a[href*="/p/"]@href'), "title": rule("a[title]@title", 'a[href*="/p/"]')}),
    "vijaysales": ((".product-item, .product-card",), {"sku": rule("@data-product-id"), "href": rule("a@href"), "title": rule("h2", "h3", "a")}),
    "croma": (('div[data-testid="product-card"]', ".product-item", ".plp-product-tile", ".product-tile-wrapper", ".product-card", ".cp-product",
               'div[class*="ProductCard"]', 'div[class*="product-card"]'),
              {"href": rule('a[href*="/p/"]@href', 'a[data-testid="product-link"]@href', "a@href"), "title": rule("h2", "h3", "a"),
               "sku": rule("[data-product-id]@data-product-id", "[data-sku]@data-sku", "[data-id]@data-id")}),
    "reliancedigital": (('div[data-testid="product-card"]', 'a[href*="/p/"]', ".sp__product", ".product-tile", ".product-item", ".product-card",
                         'div[class*="ProductCard"]', 'div[data-track="product"]'),
                        {"href": rule('a[href*="/p/"]@href', "a@href"), "title": rule("h2", "h3", "a"), "sku": rule("[data-product-id]@data-product-id", "[data-sku]@data-sku")}),
    "bigbasket": (('div[data-testid="product-card"]', 'div[qa="product-card"]', 'a[href*="/pd/"]', "div.product-card", 'div[class*="ProductCard"]',
                   'div[data-track="product"]'),
                  {"href": rule('a[href*="/pd/"]@href', "a@href"), "title": rule("h3", "h2", "a")}),
    "meesho": (('div[data-testid="productCard"]', "div.productCard", 'div[class*="productCard"]', 'a[href*="/p/"]'),
               {"href": rule('a[href*="/p/"]@href', "a.productLink@href", 'a[class*="product"]@href'),
                "title": rule("h3", "h2", "a.productTitle", 'span[class*="title"]', 'div[class*="name"]')}),
    "blinkit": (('div[tabindex="0"][role="button"]',), {"sku": rule("@id"), "title": rule("div.tw-text-300.tw-font-semibold.tw-line-clamp-2")}),
}
#: An element like one of these in a card marks it as sponsored (the card itself included).
SPONSORED: dict[str, tuple[str, ...]] = {
    "amazon": ('span.puis-label-popover-default:contains("ponsored")', 'span[data-component-type="s-sponsored-label"]', '[data-is-sponsored="true"]',
               ".AdHolder", ".s-sponsored-list-item", '[class*="s-sponsored"]', '[data-component-type="sp-sponsored-result"]'),
    "flipkart": ("div.IxWX8O",),
    "croma": ("[data-sponsored]", "[data-ad]", ".sponsored", ".ad-badge"),
    "reliancedigital": ("[data-sponsored]", "[data-promoted]", "[data-ad]", "[data-advertisement]", ".sponsored", ".promoted", ".ad-badge",
                        ".advertisement", '[data-testid="sponsored"]', '[data-testid="ad"]'),
    "bigbasket": ("[data-sponsored]", "[data-promoted]", "[data-ad]", ".sponsored", ".promoted", ".ad-badge", '[data-testid="sponsored"]'),
    "meesho": ('span:contains("Sponsored")', 'span[class*="sponsored"]', 'div[class*="sponsored"]'),
}
#: Platforms whose cards count as sponsored if their text holds the word (VijaySales and Blinkit mark none).
SPONSORED_TEXT = ("amazon", "flipkart", "croma", "reliancedigital", "bigbasket", "meesho")

_IMAGES = ('img[data-testid="review-image"]@src', ".review-image img@src", ".review-photos img@src", ".customer-image img@src")
_FILLED = rule(".star.filled, .star-filled, svg.filled", pick="count")
#: Reviews of a page: containers, then what is read in each.
REVIEWS: dict[str, tuple[tuple[str, ...], dict[str, Rule]]] = {
    "amazon": (('li[data-hook="review"]', 'div[data-hook="review"]', "li.review", 'div[id*="customer_review"]', "div.review", "div.a-section.review",
                '[data-hook="review-collapsed"]'),
               {"id": rule("@id"), "name": rule("span.a-profile-name", "div.a-profile-content span"),
                "rating": rule('i[data-hook="review-star-rating"] span.a-icon-alt, i.review-rating span.a-icon-alt', accept=DIGIT),
                "title": rule('a[data-hook="review-title"]'), "text": rule('span[data-hook="review-body"]'), "date": rule('span[data-hook="review-date"]'),
                "verified": rule('span[data-hook="avp-badge"]', 'span[data-hook="avp-badge-linkless"]', ".a-color-state.a-text-bold",
                                 'span:contains("Verified Purchase")'),
                "helpful": rule('span[data-hook="helpful-vote-statement"]'),
                "images": rule('img[data-hook="review-image-tile"]@data-src|src', pick="union"),
                "variant": rule('span[data-hook="format-strip"]', 'span[data-hook="format-strip-linkless"]', ".review-format-strip span",
                                ".review-data.review-format-strip span", ".a-row.a-spacing-mini.review-data span")}),
    "flipkart": (("div.col.x_CUu6.QccLnz, div._1AtVbE, div.col-12-12",),
                 {"id": rule('[id^="review-"]@id'), "link": rule('a[href*="reviewId="]@href'), "name": rule("p.zJ1ZGa.ZDi3w2", "p._2sc7ZR._2V5EHH", "p._2NsDsF"),
                  "rating": rule("div.MKiFS6.ojKpP6", "div._3LWZlK", "div.hGSR34", accept=DIGIT), "title": rule("p.qW2QI1", "p._2-N8zT"),
                  "text": rule("div.G4PxIA div div", "div.t-ZTKy", "div._1AtVbE div div"), "dates": rule("p.zJ1ZGa", pick="all"),
                  "verified": rule("p.Zhmv6U", "p._2mcZGG", accept=r"(?i)certified|verified"), "helpful": rule("span.Fp3hrV", "span._3c3Px5", accept=DIGIT)}),
    "vijaysales": ((".review-item, .customer-review",),
                   {"name": rule(".reviewer-name, .customer-name"), "rating": rule(".rating, .star-rating", accept=DIGIT), "title": rule(".review-title, h3"),
                    "text": rule(".review-text, .review-content, p"), "date": rule(".review-date, .date")}),
    "croma": (("ul.list > li.list-item", "li.list-item", 'div[data-testid="review-item"]', ".pdp-review-item"),
              {"id": rule("@data-review-id|data-id|id"), "name": rule('span[data-testid="reviewer-name"]', ".reviewer-name", ".review-author", ".author-name", ".customer-name"),
               "rating": rule('span[data-testid="rating"]', ".rating-value", ".star-rating", ".review-rating", accept=DIGIT), "filled": _FILLED,
               "title": rule('h3[data-testid="review-title"]', ".review-title", ".review-heading", "h4", "h5"),
               "text": rule('div[data-testid="review-text"]', ".review-text", ".review-content", ".review-body", ".review-description", "p"),
               "date": rule('span[data-testid="review-date"]', ".review-date", ".review-time", "time", ".date"),
               "verified": rule('span[data-testid="verified-badge"]', ".verified-purchase", ".verified-badge", ".verified-buyer"),
               "helpful": rule('span[data-testid="helpful-count"]', ".helpful-count", ".vote-count", ".thumbs-up-count"), "images": rule(*_IMAGES, pick="union")}),
    "reliancedigital": (("div.rd-feedback-service-review-container", 'div[class*="feedback-service-review"]'),
                        {"id": rule("@data-review-id|data-id|id"), "name": rule(".rd-feedback-service-jds-desk-body-s"),
                         "filled": rule('svg path[fill="#FFD947"]', pick="count"), "title": rule(".rd-feedback-service-review-row-title"),
                         "text": rule(".rd-feedback-service-review-row-description"), "date": rule(".rd-feedback-service-review-row-top-right"),
                         "verified": rule(".rd-feedback-service-certified-buyer-container"), "helpful": rule(".rd-feedback-service-vote-text"),
                         "images": rule(*_IMAGES, pick="union")}),
    "bigbasket": (('div[data-testid="review-item"]', "div.review-item", "div.review-card", 'div[qa="review"]', ".product-reviews .review", 'div[class*="Review"]'),
                  {"id": rule("@data-review-id|data-id|id"),
                   "name": rule('span[data-testid="reviewer-name"]', ".reviewer-name", ".review-author", 'div[qa="reviewer-name"]', ".author-name"),
                   "rating": rule('span[data-testid="rating"]', ".rating-value", ".star-rating", 'div[qa="rating"]', accept=DIGIT), "filled": _FILLED,
                   "title": rule('h3[data-testid="review-title"]', ".review-title", ".review-heading", 'div[qa="review-title"]', "h4"),
                   "text": rule('div[data-testid="review-text"]', ".review-text", ".review-content", 'div[qa="review-text"]', ".review-body", "p"),
                   "date": rule('span[data-testid="review-date"]', ".review-date", ".review-time", 'div[qa="review-date"]', "time"),
                   "verified": rule('span[data-testid="verified-badge"]', ".verified-purchase", ".verified-badge", 'div[qa="verified"]'),
                   "helpful": rule('span[data-testid="helpful-count"]', ".helpful-count", ".vote-count", 'div[qa="helpful-count"]'),
                   "images": rule(*_IMAGES[:3], 'div[qa="review-image"] img@src', pick="union")}),
    "meesho": (('div[data-testid="reviewCard"]', "div.reviewCard", 'div[class*="review"]', 'div[class*="Review"]'),
               {"name": rule('span[class*="reviewer"]', 'span[class*="name"]', 'div[class*="reviewer"]', 'p[class*="reviewer"]'),
                "rating": rule('span[class*="rating"]', 'span[class*="star"]', 'div[class*="rating"]', 'div[class*="star"]', accept=DIGIT),
                "title": rule("h3", "h4", 'span[class*="title"]', 'p[class*="title"]'), "text": rule('p[class*="review"]', 'div[class*="review"]', 'span[class*="text"]', "p"),
                "helpful": rule('span[class*="helpful"]', 'span[class*="like"]', 'div[class*="helpful"]', accept=DIGIT),
                "date": rule('span[class*="date"]', 'span[class*="time"]', 'div[class*="date"]', 'p[class*="date"]'),
                "verified": rule('span:contains("Verified")', 'span:contains("verified")', 'span[class*="verified"]', 'div[class*="verified"]')}),
}
#: What review ids begin with where they come from an attribute.
REVIEW_PREFIX = {"croma": "CROMA_", "reliancedigital": "RD_", "bigbasket": "BB_"}
#: Inventory status where nothing is printed.
AVAILABILITY_DEFAULT = {"amazon": "Unknown", "flipkart": "In Stock", "vijaysales": "In Stock", "reliancedigital": "Available", "croma": "Available",
                        "blinkit": "Out of Stock", "bigbasket": "Unknown", "meesho": "In Stock"}
#: What joins the parts of a text field.
JOIN = {
    "description": {"flipkart": " ", "vijaysales": ". ", "reliancedigital": " ", "croma": ". ", "bigbasket": ". "},
    "highlights": {"amazon": ". ", "flipkart": " | ", "vijaysales": " | ", "reliancedigital": ". ", "croma": ". ", "meesho": ", "},
    "category": {"amazon": ", ", "flipkart": ", ", "reliancedigital": " ,", "croma": " , ", "bigbasket": " > "},
    "offers": {"flipkart": "; ", "vijaysales": "; ", "reliancedigital": "; ", "croma": "; ", "meesho": ", "},
}
# ---- end of fixed values ----
