"""Logical tables over the driver's parquet files.

The driver ships TPC-H-shaped tables; the catalogue engine works on products,
reviews, keywords, rankings, urls, logs, runs and configurations.  Each logical
table is one SQL view.  The same SQL text feeds Spark (``spark.sql``) and the
DuckDB oracle (as a CTE), so both engines start from identical rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from shelfwise import schemas

# tables that grow with the data (the rest are small dimensions, broadcast or joined as they are)
FACT_TABLES = {"lineitem", "orders", "events", "documents", "pages", "conversations", "embeddings"}

RAW_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

_PLATFORM_OF = ("CASE CAST({k} % 8 AS INT) WHEN 0 THEN 'amazon' WHEN 1 THEN 'flipkart' "
                "WHEN 2 THEN 'vijaysales' WHEN 3 THEN 'reliancedigital' WHEN 4 THEN 'croma' "
                "WHEN 5 THEN 'blinkit' WHEN 6 THEN 'bigbasket' ELSE 'meesho' END")

def _n(m: int, add: int = 0) -> str:
    """SQL of ``page_id % m + add`` as text: the part of the shop markup that varies by page."""
    return f"CAST(page_id % {m} + {add} AS STRING)"


# prices printed on a page (list price below the sale price on every seventh page)
SALE = "(2500 + page_id * 37 % 90000)"
LIST = f"CASE WHEN page_id % 7 = 0 THEN {SALE} - 100 ELSE {SALE} + 500 + page_id % 1000 END"
_LD = "concat('<script type=\"application/ld+json\">', {}, '</script>')"

def _html(template: str, **parts: str) -> str:
    """SQL that prints an HTML template, each ``{name}`` replaced by an SQL value."""
    pieces = re.split(r"\{(\w+)\}", template)
    return "concat(" + ", ".join(parts[x] if i % 2 else f"'{x}'" for i, x in enumerate(pieces) if x) + ")"


#: What a product, a listing and a review page print, by platform, as ``page_rules`` reads it.
_TITLE, _LEFT, _SHOP, _STARS, _COUNT = (f"concat('Item ', {_n(101)}, ' of the shelf')", f"concat('Only ', {_n(9, 1)}, ' left in stock')",
                                        f"concat('Shop ', {_n(17)})", f"concat('4.', {_n(10)})", _n(700, 1))
_VALUES = {"title": _TITLE, "sale": f"CAST({SALE} AS STRING)", "list": f"CAST({LIST} AS STRING)", "left": _LEFT, "shop": _SHOP, "stars": _STARS,
           "count": _COUNT, "shelf": _n(12), "lot": _n(31), "off": _n(60, 1), "id": "CAST(page_id AS STRING)", "user": _n(19), "day": _n(28, 1),
           "vote": _n(40, 2), "say": f"concat('Good screen and keys of lot ', {_n(31)}, '.')", "head": f"concat('Title ', {_n(23)})",
           "score": _n(5, 1), "shade": _n(9), "lot5": _n(5),
           "hide": """CASE CAST(page_id % 9 AS INT) WHEN 3 THEN ' d-none"' WHEN 4 THEN ' d-none"' WHEN 5 THEN ' d-none"' WHEN 0 THEN '"' WHEN 1 THEN '"' WHEN 2 THEN '" style="display: block"' ELSE '" style="display: none"' END""", "asin": "lpad(CAST(page_id AS STRING), 9, '0')", "made": _n(11), "card": f"concat('Card no ', {_n(77)})"}
# product: always; priced: where a list price is printed; stocked, unstocked: by stock; listing: two cards, the second an ad on most pages; reviews: one, or two
_SITE = {
    0: {"product": """<div id="centerCol"><h1 id="title"><span id="productTitle"> {title} </span></h1><span class="a-price a-price-current"><span class="a-offscreen">₹{sale}</span></span><i><span class="a-icon-alt">{stars} out of 5 stars</span></i><span data-hook="total-review-count">{count} ratings</span></div><table><tr class="po-brand"><td>Brand</td><td>Maker {made}</td></tr></table><span class="savingsPercentage">-{off}%</span><ul id="x"><li class="a-breadcrumb-text">Shelf {shelf}</li><li class="a-breadcrumb-text">All</li></ul><span class="a-icon-text-fba">Fulfilled by <b>{shop}</b></span>""",
        "priced": """<div id="centerCol"><p><span class="a-text-strike">₹{list}</span></p></div>""",
        "stocked": """<div id="availability"><p><span> {left} </span></p></div>""", "unstocked": "",
        "card": """<div data-component-type="s-search-result" data-asin="B{asin}"><h2><a class="a-link-normal s-no-outline" href="/dp/B{asin}"><span>{card}</span></a></h2></div>""",
        "ad": """<div data-component-type="s-search-result" data-asin="C{asin}"><span data-component-type="s-sponsored-label">Ad</span><h2><a href="/x"><span>Second</span></a></h2></div>""",
        "review": """<ul><li data-hook="review" id="RV{id}A"><span class="a-profile-name">User {user}</span><i data-hook="review-star-rating"><span class="a-icon-alt">{score}.0 out of 5 stars</span></i><a data-hook="review-title"><span>{head}</span></a><span data-hook="review-date">Reviewed in India on {day} January 2024</span><span data-hook="avp-badge">Verified Purchase</span><span data-hook="format-strip">Colour: Shade {shade}</span><span data-hook="review-body"><span>{say}</span></span><span data-hook="helpful-vote-statement">{vote} people found this helpful</span></li></ul>""",
        "silent": """<ul><li data-hook="review" id="RV{id}B"><span class="a-profile-name">Silent</span></li></ul>"""},
    1: {"product": """<div class="v1zwn21j v1zwn26"><span>{title}</span></div><div class="v1zwn21k v1zwn20">₹{sale}</div><div class="css-146c3p1">{stars}</div><a href="/ratings-reviews/1"><div class="css-146c3p1">10 Ratings | {count} Reviews</div></a><div class="grid-formation-dynamic"><div class="v1zwn21l v1zwn27">Brand</div><div class="v1zwn21k v1zwn26">Maker {made}</div></div><div class="v1zwn21z v1zwn20">{off}% off</div><div class="faikzn"><a>Home</a><a>Shelf {shelf}</a><a>All</a></div><div class="v1zwn21k v1zwn25">Fulfilled by {shop}</div>""",
        "priced": """<div class="v1zwn21l v1zwn21">₹{list}</div>""", "stocked": """<div class="_16FRp0">{left}</div>""", "unstocked": "",
        "card": """<div data-id="F{id}"><a href="/thing/p/itm{id}A?fm=organic" title="{card}">open</a></div>""",
        "ad": """<div data-id="G{id}"><div><a href="/thing/p/itm{id}B?fm=search" title="Second">open</a></div></div>""",
        "review": """<div class="col x_CUu6 QccLnz"><div id="review-RV{id}A"></div><p class="zJ1ZGa ZDi3w2">User {user}</p><div class="MKiFS6 ojKpP6">{score}</div><p class="qW2QI1">{head}</p><div class="t-ZTKy">{say}READ MORE</div><p class="zJ1ZGa">Jan, 2024</p><p class="Zhmv6U">Certified Buyer</p><span class="Fp3hrV">{vote}</span></div>""",
        "silent": """<div class="col x_CUu6 QccLnz"><div id="review-RV{id}B"></div><p class="zJ1ZGa ZDi3w2">Silent</p></div>"""},
    2: {"product": """<div class="page-title"><h1>{title}</h1></div><div class="product__price--deatils d-none"><b data-final-price="1" data-mrp="2"></b></div><div class="product__price--deatils"><b data-final-price="{sale}"></b></div><div class="product__title--reviews-star" data-rating-summary="{stars}"></div><div class="product__title--stats"><span>{stars} (4 Ratings & {count} Reviews)</span></div><div class="productspecification"><ul><li><span class="panel-list-key">Brand</span><span class="panel-list-value">Maker {made}</span></li></ul></div><p class="product__price--discount-label">{off}% off</p><p class="product__tags--label{hide}>Badge <i>no</i> {lot5}</p>""",
        "priced": """<div class="product__price--deatils"><i data-mrp="{list}"></i></div>""",
        "stocked": """<p class="instock__text d-none">no</p><p class="instock__text">yes</p>""", "unstocked": """<p class="instock__text d-none">no</p>""",
        "card": """<div class="product-card" data-product-id="V{id}A"><h2>{card}</h2><a href="/p/{id}">go</a></div>""",
        "ad": """<div class="product-item"><h2>Second</h2><a href="/second-{id}.html">go</a></div>""",
        "review": """<div class="review-item"><b class="reviewer-name">User {user}</b><b class="rating">{score} of 5</b><h3>{head}</h3><p class="review-text">{say}</p><b class="review-date">{day}/01/2024</b></div>""",
        "silent": """<div class="review-item"><b class="reviewer-name">Silent</b></div>"""},
    3: {"product": """<h1 data-testid="product-title">{title}</h1><div class="product-price">₹{sale}</div><b class="rating-value">{stars}</b><b class="review-count">{count}</b><ul id="specification"><li class="specifications-list"><span>Seller</span><div class="specifications-list--right"><ul><li>{shop}</li></ul></div></li><li class="specifications-list"><span>Brand</span><div class="specifications-list--right"><ul><li>Maker {made}</li></ul></div></li></ul><b class="product-price-discount">{off}% off</b><div class="breadcrumb"><a>Shelf {shelf}</a><a>All</a></div>""",
        "priced": """<div class="product-marked-price">₹{list}</div>""", "stocked": """<div class="stock-status">{left}</div>""", "unstocked": "",
        "card": """<div data-testid="product-card" data-product-id="R{id}A"><h3>{card}</h3><a href="/x/p/R{id}A">go</a></div>""",
        "ad": """<div data-testid="product-card"><i class="promoted"></i><h3>Second</h3><a href="/x/p/R{id}B">go</a></div>""",
        "review": """<div class="rd-feedback-service-review-container" id="RV{id}A"><b class="rd-feedback-service-jds-desk-body-s">User {user}</b><svg><path fill="#FFD947"></path><path fill="#FFD947"></path><path fill="#EEE"></path></svg><b class="rd-feedback-service-review-row-title">{head}</b><p class="rd-feedback-service-review-row-description">{say}</p><b class="rd-feedback-service-review-row-top-right">{day}/01/2024</b><i class="rd-feedback-service-certified-buyer-container">Certified</i><b class="rd-feedback-service-vote-text">{vote}</b></div>""",
        "silent": """<div class="rd-feedback-service-review-container" id="RV{id}B"><b class="rd-feedback-service-jds-desk-body-s">Silent</b></div>"""},
    4: {"product": """<h1 data-testid="product-title">{title}</h1><div class="cp-price main-product-price"><b class="new-price"><b class="amount">₹{sale}</b></b></div><div class="cp-rating"><span>{stars}</span><span class="text"><a class="pr-review">({count} Reviews)</a></span></div><ul class="cp-specification-spec-info"><li class="cp-specification-spec-title"><h4>Brand</h4></li><li class="cp-specification-spec-details">Maker {made}</li></ul><b class="discount-info">{off}% off</b><div class="cp-breadcrumb"><ul class="list"><li><a>Shelf {shelf}</a></li><li><a>All</a></li></ul></div>""",
        "priced": """<div class="cp-price discount"><b class="old-price"><b class="amount">₹{list}</b></b></div>""", "stocked": """<div data-testid="stock-status">{left}</div>""", "unstocked": "",
        "card": """<div data-testid="product-card"><h3>{card}</h3><a href="/x/p/{id}1">go</a></div>""",
        "ad": """<div data-testid="product-card"><i class="ad-badge"></i><h3>Second</h3><a href="/x/p/{id}2">go</a></div>""",
        "review": """<ul class="list"><li class="list-item" data-review-id="RV{id}A"><b class="reviewer-name">User {user}</b><b class="star-rating">{score}</b><h4>{head}</h4><p>{say}</p><time>{day}/01/2024</time><i class="verified-badge">Verified</i><b class="vote-count">{vote}</b></li></ul>""",
        "silent": """<ul class="list"><li class="list-item" data-review-id="RV{id}B"><b class="reviewer-name">Silent</b></li></ul>"""},
    5: {"product": """<span data-test-id="pdp-price">₹{sale}</span><div data-test-id="pdp-rating">{stars}</div><span data-test-id="pdp-review-count">{count}</span><span data-test-id="pdp-brand">Maker {made}</span><span data-test-id="pdp-offer">{off}% off</span>""",
        "priced": """<span data-test-id="pdp-mrp">₹{list}</span>""", "stocked": """<button>ADD</button>""", "unstocked": """<button>Notify</button>""",
        "card": """<div tabindex="0" role="button" id="{id}1"><div class="tw-text-300 tw-font-semibold tw-line-clamp-2">{card}</div></div>""",
        "ad": """<div tabindex="0" role="button" id="{id}2"><div class="tw-text-300 tw-font-semibold tw-line-clamp-2">Second</div></div>""",
        "review": "", "silent": ""},
    6: {"product": """<h1 data-testid="product-title">{title}</h1><span data-testid="selling-price">₹{sale}</span><span data-testid="rating">{stars}</span><span data-testid="review-count">{count}</span><span data-testid="brand">Maker {made}</span><b class="offer-text">{off}% off</b><nav data-testid="breadcrumb"><a>Shelf {shelf}</a><a>All</a></nav>""",
        "priced": """<span data-testid="mrp-price">₹{list}</span>""", "stocked": """<div class="stock-status">{left}</div>""", "unstocked": "",
        "card": """<div qa="product-card"><h3>{card}</h3><a href="/pd/{id}1/x">go</a></div>""",
        "ad": """<div qa="product-card"><i data-testid="sponsored"></i><h3>Second</h3><a href="/pd/{id}2/x">go</a></div>""",
        "review": """<div class="review-card" data-review-id="RV{id}A"><b class="reviewer-name">User {user}</b><b class="star filled"></b><b class="star filled"></b><b class="star filled"></b><b class="star"></b><b class="review-heading">{head}</b><p class="review-body">{say}</p><time>{day}/01/2024</time><i class="verified-badge">Verified</i><b class="vote-count">{vote}</b></div>""",
        "silent": """<div class="review-card" data-review-id="RV{id}B"><b class="reviewer-name">Silent</b></div>"""},
    7: {"product": """<h1 class="productTitle">{title}</h1><b class="salePrice">₹{sale}</b><b class="rating">{stars}</b><b class="reviewCount">{count}</b><span class="brand">Maker {made}</span><ul class="offers"><li>{off}% off</li></ul><p class="breadcrumb"><a>Shelf {shelf}</a><a>All</a></p><b class="sellerName">{shop}</b><b class="sellerRating">{score}.5</b>""",
        "priced": """<b class="originalPrice">₹{list}</b>""", "stocked": """<b class="availability">{left}</b>""", "unstocked": "",
        "card": """<div class="productCard"><h3>{card}</h3><a href="/x/p/{id}1">go</a></div>""",
        "ad": """<div class="productCard"><span class="is-sponsored"></span><h3>Second</h3><a href="/x/p/{id}2">go</a></div>""",
        "review": """<div class="reviewCard"><span class="reviewer">User {user}</span><span class="rating">{score}</span><h3>{head}</h3><p class="review-text">{say}</p><span class="date">{day}/01/2024</span><span class="verified">Verified</span><span class="helpful">{vote}</span></div>""",
        "silent": """<div class="reviewCard"><span class="reviewer">Silent</span></div>"""},
}


def _site_part(name: str, when: str | None = None) -> str:
    """SQL of one part by platform, printed where ``when`` holds."""
    out = "CASE CAST(page_id % 8 AS INT) " + " ".join(f"WHEN {k} THEN {_html(v[name], **_VALUES) if v[name] else chr(39) * 2}" for k, v in _SITE.items()) + " END"
    return out if when is None else f"CASE WHEN {when} THEN {out} ELSE '' END"


_SITE_PARTS = [_site_part("product"), _site_part("priced", "page_id % 5 <> 0"), _site_part("stocked", "page_id % 7 <> 0"), _site_part("unstocked", "page_id % 21 = 0"),
               _site_part("card"), _site_part("ad", "page_id % 3 <> 0"), _site_part("review"), _site_part("silent", "page_id % 5 = 1")]
# shop markup appended to every stored page, its values derived from the page's key
_SHOP_PARTS = [
    # JSON-LD: an object, a @graph, or a list whose nested product must not count
    "CASE page_id % 3 WHEN 0 THEN " + _LD.format(
        f"""concat('{{"@type":"Product","name":"Ld item ', {_n(97)}, '","description":"About ', {_n(89)}, '","brand":{{"@type":"Brand","name":"Maker ', {_n(7)},
 '"}},"image":["https://img.example.com/ld', {_n(1000)}, '.jpg"],"offers":{{"price":"', CAST({SALE} + 1 AS STRING),
 '"}},"aggregateRating":{{"ratingValue":"4.', {_n(10)}, '","reviewCount":"', {_n(500)}, '"}}}}')""")
    + " WHEN 1 THEN " + _LD.format(
        f"""concat('{{"@graph":[{{"@type":"WebPage","name":"Page"}},{{"@type":"Product","name":"Graph item ', {_n(97)}, '","brand":"Maker ', {_n(7)},
 '","image":"https://img.example.com/g', {_n(1000)}, '.jpg","offers":{{"lowPrice":"', CAST({SALE} + 1 AS STRING), '","highPrice":"',
 CAST({LIST} + 1 AS STRING), '"}},"aggregateRating":{{"ratingValue":"3.', {_n(10)}, '","ratingCount":"', {_n(300)}, '"}}}}]}}')""")
    + " ELSE " + _LD.format("""'{"@type":"ItemList","itemListElement":[{"@type":"Product","name":"Nested"}]}'""") + " END",
    # star shares: a table, bars, or counts
    f"""CASE page_id % 3 WHEN 0 THEN concat('<table id="histogramTable"><tr><td>Five</td><td>', {_n(60)}, '%</td></tr><tr><td>Four</td><td>20%</td></tr><tr><td>Three</td><td>10%</td></tr><tr><td>Two</td><td>5%</td></tr><tr><td>One</td><td>', {_n(6)}, '%</td></tr></table>')
 WHEN 1 THEN concat('<i style="width: ', {_n(70)}, '%"></i><i style="width: 11%"></i><i style="width: 7%"></i><i style="width: 5%"></i><i style="width: ', {_n(4)}, '%"></i>')
 ELSE concat('<b class="star-count">', {_n(900, 100)}, '</b><b class="star-count">200</b><b class="star-count">100</b><b class="star-count">50</b><b class="star-count">', {_n(50)}, '</b>') END""",
    f"""'<table><tr><th>Brand</th><td>Maker ', {_n(11)}, '</td></tr><tr><th>Model</th><td>old</td></tr><tr><th>Model</th><td>M', {_n(53)}, '</td></tr><tr><th>Colour</th><td>Shade ', {_n(9)},
 '</td></tr><tr><th>Width</th><td>', {_n(40, 10)}, ' cm</td></tr><tr><th>Depth</th><td>', {_n(30, 5)}, ' cm</td></tr><tr><th>Height</th><td>', CASE WHEN page_id % 4 = 0 THEN ' ' ELSE '9 cm' END,
 '</td></tr><tr><th>Item Weight</th><td>', {_n(9, 1)}, ' kg</td></tr><tr><th>Manufacturer</th><td>Plant ', {_n(13)}, '</td></tr><tr><th>Length</th><td>', {_n(20, 2)}, ' cm</td></tr></table>'""",
    f"""'<ul><li class="breadcrumb-item"><a>Home</a></li><li class="breadcrumb-item"><a>Shelf ', {_n(12)}, '</a></li><li class="breadcrumb-item"><a>Shelf ', {_n(4)}, '</a></li></ul>'""",
    f"""'<img data-old-hires="https://img.example.com/big', {_n(200)}, '.jpg" src="/s.jpg"><img srcset="https://img.example.com/', {_n(50)}, '.jpg 1x, https://img.example.com/x.jpg 2x">',
 '<img src="https://i.ytimg.com/vi/', lpad(CAST(page_id AS STRING), 11, 'v'), '/0.jpg"><a data-clip="https://cdn.example.com/', {_n(300)}, '.mp4"></a>'""",
    f"""'<ul><li data-defaultasin="B', {_n(900, 100)}, '" title="Shade ', {_n(9)}, '"><img src="https://img.example.com/v.jpg"></li><li data-asin="C', {_n(800, 100)}, '">other</li></ul>'""",
    f"""'<span class="offer-box">-', {_n(60, 1)}, '%</span><div class="offer-box">Extra ', {_n(15, 1)}, '% off</div>'""",
    f"""CASE WHEN page_id % 2 = 0 THEN concat('<div class="delivery-block">FREE delivery by Friday, January ', {_n(28, 1)}, '</div>')
 ELSE concat('<div class="delivery-block">₹', {_n(90, 10)}, ' delivery in ', {_n(6, 2)}, ' days</div>') END""",
    f"""'<p>Best Sellers Rank: #', {_n(900, 1)}, ' in Laptops</p>', CASE WHEN page_id % 2 = 0 THEN '<i class="mvt-ac-badge"></i>' ELSE '' END,
 CASE WHEN page_id % 3 = 0 THEN '<i class="mvt-best-seller-badge"></i>' ELSE '' END""",
    f"""'<div id="feature-bullets"><div><ul><li><span>Sixteen GB of memory, lot ', {_n(31)}, '</span></li><li>short</li></ul></div><ul><li>A second list of points</li></ul></div>'""",
    f"""'<div data-hook="cr-insights-widget-summary"><div>Buyers like</div> <p>the <b>screen</b> of lot ', {_n(31)}, '.</p></div><span>Deal ends in ', {_n(48)}, ' hours</span>'""",
    f"""'<div tabindex="0" role="button" id="', {_n(400, 100)}, '"><div class="tw-text-300 tw-font-semibold tw-line-clamp-2">Milk & Bread ', {_n(25)}, '!</div></div><div tabindex="0" role="button" id="7"></div>',
 '<div tabindex="0" role="button" id="9"><div class="tw-text-300 tw-font-semibold tw-line-clamp-2">Rice</div></div>'""",
    f"""'<div class="col EPCmJX review" data-hook="review" id="RV', CAST(page_id AS STRING), 'A"><b class="a-profile-name">User ', {_n(19)}, '</b><i>', {_n(5, 1)}, '.0 out of 5</i><a data-hook="review-title"><b>Title</b> ', {_n(23)},
 '</a><b data-hook="review-date">Reviewed in India on ', {_n(28, 1)}, ' January 2024</b><a data-hook="format-strip">Colour: Shade ', {_n(9)}, '</a>', CASE WHEN page_id % 2 = 0 THEN '<i>Verified Purchase</i>' ELSE '' END,
 '<div data-hook="review-body"><div>Good <b>screen</b> and </div><p>keys of lot ', {_n(31)}, '.</p></div><b class="cr-vote-text">', {_n(40, 2)}, ' people found this helpful</b></div>'""",
    """CASE WHEN page_id % 2 = 1 THEN concat('<div class="col EPCmJX review" data-hook="review" id="RV', CAST(page_id AS STRING), 'B"><b class="a-profile-name">Silent</b></div>') ELSE '' END""",
]

VIEW_SQL: dict[str, str] = {
    # shop_pages: every stored page with shop markup (prices, JSON-LD, cards, reviews) at its end
    "shop_pages": "SELECT page_id, url, concat(html, " + ",\n ".join(_SHOP_PARTS + _SITE_PARTS) + ") AS html\nFROM pages",
    # products: one snapshot row per lineitem; scraper_id = ship month
    "products": f"""SELECT md5(concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING))) AS product_id,
 {_PLATFORM_OF.format(k='l_suppkey')} AS platform,
 concat('SKU', CAST(l_partkey AS STRING)) AS sku,
 concat(p_name, ' ', p_type) AS title,
 CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE p_brand END AS brand,
 CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(10,2)) END AS price,
 CASE WHEN l_discount > 0 THEN CAST(round(CAST(l_extendedprice AS DECIMAL(10,2)) * (1 - CAST(l_discount AS DECIMAL(3,2))), 2) AS DECIMAL(10,2)) END AS sale_price,
 CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(1 + (CAST(l_quantity AS INT) % 9) * 0.5 AS DECIMAL(3,2)) END AS rating,
 CAST(l_quantity AS INT) * l_linenumber AS review_count,
 l_linestatus = 'O' AS is_active,
 CASE WHEN l_returnflag = 'R' THEN 'exclude' ELSE 'include' END AS include_exclude,
 CAST(l_shipdate AS DATE) AS scraped_date,
 lpad(CAST(year(l_shipdate) * 100 + month(l_shipdate) AS STRING), 10, '0') AS scraper_id,
 concat('https://www.example.com/', CASE CAST(l_suppkey % 8 AS INT) WHEN 0 THEN 'amazon' WHEN 1 THEN 'flipkart' WHEN 2 THEN 'vijaysales' WHEN 3 THEN 'reliancedigital' WHEN 4 THEN 'croma' WHEN 5 THEN 'blinkit' WHEN 6 THEN 'bigbasket' ELSE 'meesho' END, '/p/', CAST(l_partkey AS STRING)) AS product_url
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    # scraping_logs: one ingest session per order
    "scraping_logs": f"""SELECT o_orderkey AS id, {_PLATFORM_OF.format(k='o_custkey')} AS platform,
 CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'started' END AS status,
 CAST(o_custkey % 50 AS INT) AS products_added, CAST(o_orderkey % 70 AS INT) AS products_updated,
 CAST(o_orderkey % 4 AS INT) AS errors_count,
 CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(o_orderkey % 7200 AS INT) END AS duration_seconds,
 o_orderdate AS created_at
FROM orders""",
    # scraper_runs: one run per order
    "scraper_runs": f"""SELECT lpad(CAST(o_orderkey AS STRING), 10, '0') AS scraper_id, o_custkey % 40 AS configuration_id,
 {_PLATFORM_OF.format(k='o_custkey')} AS platform, o_orderpriority AS category,
 CASE WHEN o_orderkey % 3 = 0 THEN c_mktsegment END AS tag,
 CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status,
 CAST(o_orderkey % 100 AS INT) AS products_scraped, CAST(o_custkey % 30 AS INT) AS reviews_scraped, CAST(o_orderkey % 20 AS INT) AS rankings_scraped,
 CAST(o_orderkey % 5 AS INT) AS errors_count,
 CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(o_orderkey % 7200 AS INT) END AS duration_seconds, o_orderdate AS created_at
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    # reviews: one review per document
    "reviews": f"""SELECT d.doc_id AS id, concat('R', CAST(d.doc_id AS STRING)) AS review_id, {_PLATFORM_OF.format(k='d.doc_id')} AS platform,
 concat('SKU', CAST(d.doc_id % 300 AS STRING)) AS sku, concat('user', CAST(d.doc_id % 90 AS STRING)) AS reviewer_name,
 CASE WHEN d.n_chars % 11 = 0 THEN NULL ELSE CAST(1 + (d.n_chars % 9) * 0.5 AS DECIMAL(3,2)) END AS rating,
 d.text AS review_title, d.text AS review_text,
 coalesce(l.quality, 0) = 1 AS verified_purchase, CAST(d.n_chars % 25 AS INT) AS helpful_count,
 CASE WHEN d.doc_id % 4 = 0 THEN concat('["http://img.example.com/', CAST(d.doc_id AS STRING), '.jpg"]') WHEN d.doc_id % 4 = 1 THEN '[]' WHEN d.doc_id % 4 = 2 THEN 'null' END AS review_images,
 lpad(CAST(20240101 + d.doc_id % 28 AS STRING), 10, '0') AS scraper_id
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    # keywords: one per event user
    "keywords": f"""SELECT k AS id, {_PLATFORM_OF.format(k='k')} AS platform, concat('keyword ', CAST(k AS STRING)) AS keyword, k % 5 <> 0 AS status
FROM (SELECT DISTINCT user_id AS k FROM events) t""",
    # search_items: one search-result card per event
    "search_items": f"""SELECT event_id AS item_id, user_id AS keyword_id, {_PLATFORM_OF.format(k='user_id')} AS platform, CAST(ts AS DATE) AS search_date,
 concat('SKU', CAST(event_id % 250 AS STRING)) AS sku, CAST(1 + (event_id + user_id) % 5 AS INT) AS page,
 event_type = 'error' AS is_sponsored, ts AS created_at
FROM events""",
    # scraping_urls: one queued url per page
    "scraping_urls": f"""SELECT page_id AS id, {_PLATFORM_OF.format(k='page_id')} AS platform, url,
 CASE CAST(page_id % 4 AS INT) WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'processing' ELSE 'pending' END AS status,
 CAST(page_id % 7 AS INT) AS priority, CAST(page_id % 3 AS INT) AS retry_count
FROM pages""",
    # rankings: organic cards with a position that follows from the card (no window per keyword)
    "rankings": """SELECT item_id AS id, keyword_id, platform, sku, page,
 CAST(1 + (item_id * 7 + keyword_id) % 120 AS INT) AS position,
 lpad(CAST(year(created_at) * 10000 + month(created_at) * 100 + day(created_at) AS STRING), 10, '0') AS scraper_id, created_at
FROM search_items WHERE NOT is_sponsored""",
    # scraper_configurations: one per configuration_id seen in runs
    "scraper_configurations": """SELECT configuration_id AS id, min(platform) AS platform, min(category) AS category, min(tag) AS tag,
 CASE WHEN configuration_id % 5 = 0 THEN 'paused' WHEN configuration_id % 7 = 0 THEN 'inactive' ELSE 'active' END AS status,
 CAST(count(*) AS INT) AS total_runs, max(created_at) AS last_run_at, max(scraper_id) AS last_scraper_id
FROM scraper_runs GROUP BY configuration_id""",
    # search_pages: one row per (keyword, results page) with its organic card count
    "search_pages": """SELECT keyword_id, page, count(*) FILTER (WHERE NOT is_sponsored) AS organic_items
FROM search_items GROUP BY keyword_id, page""",
    # page_attempts: every four events are the attempts of one page; an error event returned no rows
    "page_attempts": """SELECT CAST((event_id - event_id % 4) / 4 AS BIGINT) AS page_key, CAST(event_id % 4 + 1 AS INT) AS attempt,
 CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS rows_found, ts AS attempted_at
FROM events""",
    # platforms: the fixed platform dimension (8 rows)
    "platforms": "SELECT * FROM (VALUES " + ", ".join(
        f"('{p}', '{n}')" for p, n in schemas.PLATFORMS) + ") AS t(platform, name)",
}

VIEW_DEPS = {
    "shop_pages": ["pages"], "products": ["lineitem", "part"], "scraping_logs": ["orders"],
    "scraper_runs": ["orders", "customer"], "reviews": ["documents", "labels"],
    "keywords": ["events"], "search_items": ["events"], "scraping_urls": ["pages"],
    "rankings": ["search_items"], "scraper_configurations": ["scraper_runs"], "platforms": [],
    "search_pages": ["search_items"], "page_attempts": ["events"],
}
# CTE order: parents before children
VIEW_ORDER = ["shop_pages", "products", "scraping_logs", "scraper_runs", "reviews", "keywords", "search_items",
              "scraping_urls", "rankings", "scraper_configurations", "platforms", "search_pages",
              "page_attempts"]


def widen(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Spread a scan that yields fewer splits than the cluster has cores.

    A parquet file with one row group is read by one task however large it is,
    and every per-row expression above the scan (hashes, regexes) would then
    run on one core.  Such scans get a round-robin repartition to the default
    parallelism.  Big inputs (many files / row groups) already have more splits
    than cores and are left alone, so no extra shuffle happens at scale.
    Filters and column pruning still reach the scan below the repartition.

    The split hashes the leading numeric (key) columns: deterministic under
    task retries without the local sort a round-robin split needs.
    """
    target = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    numeric = [f.name for f in df.schema.fields
               if f.dataType.typeName() in ("long", "integer", "short", "double", "float")][:2]
    return df.repartition(target, *(numeric or df.columns[:1]))


class Tables:
    """Resolves raw driver tables and logical views for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._cache:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            if name in FACT_TABLES:
                df = widen(self.spark, df)
            df.createOrReplaceTempView(name)
            self._cache[name] = df
        return self._cache[name]

    def view(self, name: str) -> DataFrame:
        if name not in self._cache:
            for dep in VIEW_DEPS[name]:
                (self.view if dep in VIEW_SQL else self.raw)(dep)
            df = self.spark.sql(VIEW_SQL[name])
            df.createOrReplaceTempView(name)
            self._cache[name] = df
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEW_SQL:
            return self.view(name)
        if name in RAW_TABLES:
            return self.raw(name)
        raise AttributeError(name)


def _needed(sql: str) -> list[str]:
    found = {v for v in VIEW_SQL if re.search(rf"\b{v}\b", sql)}
    stack = list(found)
    while stack:
        for dep in VIEW_DEPS[stack.pop()]:
            if dep in VIEW_SQL and dep not in found:
                found.add(dep)
                stack.append(dep)
    return [v for v in VIEW_ORDER if v in found]


def oracle(body: str) -> str:
    """Prefix ``body`` with the CTEs of every logical view it mentions."""
    views = _needed(body)
    if not views:
        return body
    ctes = ",\n".join(f"{v} AS (\n{VIEW_SQL[v]}\n)" for v in views)
    stripped = body.lstrip()
    if stripped[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{stripped[15:]}"
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"
