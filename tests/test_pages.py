"""Page jobs on small hand-written pages, one positive and one fallback case per rule."""

import datetime as dt

from pyspark.sql import functions as F

from shelfwise.operators import page_reader as rd
from shelfwise.operators import pages as pg
from shelfwise.operators import ranking as rk

AMAZON_PRODUCT = """<html><head><title>Amazon.in: Dell Inspiron</title>
<meta property="og:title" content="Dell Inspiron 15"></head><body>
<div id="centerCol"><h1 id="title"><span id="productTitle">  Dell Inspiron 15 3520 Laptop  </span></h1>
<a id="bylineInfo" href="/dell">Dell</a>
<div id="corePriceDisplay_desktop_feature_div"><span class="a-price-symbol">₹</span></div><span class="a-price"><span class="a-offscreen">₹49,999</span></span>
<span class="a-text-strike">₹59,999</span>
<i><span class="a-icon-alt">4.3 out of 5 stars</span></i><span id="acrCustomerReviewText">1,234 ratings</span>
<div id="availability"><span>In stock</span></div>
<span class="savingsPercentage">-17%</span>
<table><tr class="po-brand"><td>Brand</td><td>Dell</td></tr><tr class="po-color"><td>Colour</td><td>Black</td></tr>
<tr class="po-model_name"><td>Model Name</td><td>Inspiron 3520</td></tr></table>
<div id="feature-bullets"><ul><li><span>Intel Core i5 processor, 16 GB RAM</span></li><li><span>short</span></li></ul></div>
<table id="productDetails_techSpec_section_1">
<tr><th> Brand </th><td> Dell </td></tr><tr><th>Model Name</th><td>Inspiron 3520</td></tr>
<tr><th>Colour</th><td>Black</td></tr><tr><th>Item Weight</th><td>1.8 kg</td></tr>
<tr><th>Length</th><td>35 cm</td></tr><tr><th>Width</th><td>24 cm</td></tr><tr><th>Height</th><td>2 cm</td></tr>
<tr><th>Blank</th><td>  </td></tr></table>
<img id="landingImage" data-old-hires="https://m.media-amazon.com/a.jpg" src="https://m.media-amazon.com/a_small.jpg">
<div class="imageThumb"><img src="https://m.media-amazon.com/b.jpg"></div><img srcset="https://m.media-amazon.com/b.jpg 1x, https://m.media-amazon.com/b2.jpg 2x">
<img src="/relative.jpg"><div id="altImages"><div class="videoThumbnail"><img src="https://i.ytimg.com/vi/abcdefghijk/default.jpg"></div></div>
<table id="histogramTable"><tr><td>5 star</td><td><span aria-hidden="true">60%</span></td></tr><tr><td>4 star</td><td><span aria-hidden="true">20%</span></td></tr>
<tr><td>3 star</td><td><span aria-hidden="true">10%</span></td></tr><tr><td>2 star</td><td><span aria-hidden="true">5%</span></td></tr><tr><td>1 star</td><td><span aria-hidden="true">5%</span></td></tr></table>
<span>Best Sellers Rank: #1,234 in Computers</span>
<div class="a-breadcrumb"><ul><li class="breadcrumb-item a-breadcrumb-text"><a>Computers</a></li><li class="breadcrumb-item a-breadcrumb-text"><a>Laptops</a></li>
<li class="breadcrumb-item a-breadcrumb-text"><a>Laptops</a></li></ul></div>
<a class="a-icon-text-fba">Fulfilled by Cocoblu Retail</a>
<ul id="variation_color_name"><li data-defaultasin="B0VARBLACK" title="Black">Black</li>
<li data-defaultasin="B0VARSILVR" title="Silver">Silver</li></ul>
<div id="deliveryBlockMessage"><span data-csa-c-delivery-price="FREE" data-csa-c-delivery-time="Friday, 12 January">x</span></div>
<div class="delivery-block">FREE delivery by Friday, 12 January</div>
</div></body></html>"""

CROMA_JSONLD = """<html><head><title>x</title>
<script type="application/ld+json">{"@type":"BreadcrumbList","itemListElement":[]}</script>
<script type="application/ld+json">{"@context":"https://schema.org","@type":"Product","name":"Samsung Galaxy S24",
"description":"A phone","brand":{"@type":"Brand","name":"Samsung"},"image":["https://img.croma.com/1.jpg","https://img.croma.com/2.jpg"],
"offers":{"@type":"AggregateOffer","lowPrice":"74999","highPrice":"79999","price":"74999"},
"aggregateRating":{"ratingValue":"4.4","reviewCount":"321"}}</script></head><body><p>no markup</p></body></html>"""

RD_SWAP = """<html><head><script type="application/ld+json">{"@type":"Product","name":"LG TV 55","brand":"LG",
"image":"https://rd.com/tv.jpg","offers":{"price":"65000"}}</script></head><body>
<div class="pdp__product-name">LG 139 cm 4K TV</div><span class="product-price">₹65,000</span><span class="product-marked-price">₹59,990</span>
</body></html>"""

FLIPKART_COUNTS = """<html><body><span class="v1zwn21j v1zwn26">Redmi Note 13</span>
<div class="Nx9bqj CxhGGd">₹17,999</div><div class="hl05eU"><p><b class="yRaY8j">₹20,999</b></p></div>
<ul><li><span class="star-count">600</span></li><li><span class="star-count">200</span></li>
<li><span class="star-count">100</span></li><li><span class="star-count">50</span></li><li><span class="star-count">50</span></li></ul>
<ul class="lpfPv5"><li><b class="MDKzf4">600</b></li><li><b class="MDKzf4">200</b></li><li><b class="MDKzf4">100</b></li><li><b class="MDKzf4">50</b></li><li><b class="MDKzf4">50</b></li></ul>
<div class="faikzn"><div><a>Home</a></div><a class="breadcrumb-link">Mobiles</a></div><div class="_5Pmv5S"><span class="breadcrumb-link">Home</span></div>
</body></html>"""

SEARCH_PAGE = """<html><body>
<div data-component-type="s-search-result" data-asin="B000000001"><h2><a href="/dp/B000000001">Organic one</a></h2></div>
<div data-component-type="s-search-result" data-asin="B000000002"><span class="puis-label-popover-default">Sponsored</span><h2>Ad card</h2></div>
<div data-component-type="s-search-result" data-asin="B000000003"><h2><a href="/dp/B000000003?fm=organic"><span>Organic two</span></a></h2></div>
<div data-component-type="s-search-result" data-asin="B000000004"><div class="AdHolder"><h2><a href="/x?fm=ad-slot">Marked by class</a></h2></div></div>
<div data-component-type="s-search-result" data-asin="B000000005"><h2>Organic three</h2></div>
</body></html>"""

REVIEWS_PAGE = """<html><body>
<div id="R1ABCDEF" data-hook="review"><div><div><span class="a-profile-name">Asha</span></div></div>
<i class="review-rating"><span class="a-icon-alt">4.0 out of 5 stars</span></i><a data-hook="review-title">Great laptop</a>
<span data-hook="review-date">Reviewed in India on 15 January 2024</span>
<span data-hook="format-strip">Colour: Black Verified Purchase</span><span data-hook="avp-badge">Verified Purchase</span>
<span data-hook="review-body">Fast and light.</span><span class="cr-vote-text" data-hook="helpful-vote-statement">12 people found this helpful</span></div>
<div id="R2GHIJKL" data-hook="review"><span class="a-profile-name">Ravi</span>
<i class="review-rating"><span class="a-icon-alt">2.0 out of 5 stars</span></i><a data-hook="review-title">Meh</a>
<span data-hook="review-date">Reviewed in India on 3 February 2024</span>
<span data-hook="review-body">Battery weak.</span><span data-hook="helpful-vote-statement" class="cr-vote-text">One person found this helpful</span></div>
<div id="R3MNOPQR" data-hook="review"><span class="a-profile-name">NoText</span></div>
</body></html>"""

BLINKIT_CARDS = """<html><body>
<div tabindex="0" role="button" id="101"><div class="tw-text-300 tw-font-semibold tw-line-clamp-2">Amul Taaza Milk 500 ml</div></div>
<div tabindex="0" role="button" id="102"><div class="tw-text-300 tw-font-semibold tw-line-clamp-2">Britannia Bread!</div></div>
<div tabindex="0" role="button" id="103"></div>
<div tabindex="0" role="button" id="101"><div class="tw-text-300 tw-font-semibold tw-line-clamp-2">Amul Taaza Milk 500 ml</div></div>
</body></html>"""


def pages_df(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, platform string")


def test_amazon_product_record(spark):
    df = pages_df(spark, [(1, "https://www.amazon.in/Dell/dp/B0TESTTEST/ref=x", AMAZON_PRODUCT, "amazon")])
    r = pg.page_products(df).first()
    assert r.title == "Dell Inspiron 15 3520 Laptop"
    assert r.sku == "B0TESTTEST"
    assert float(r.price) == 59999.0 and float(r.sale_price) == 49999.0
    assert float(r.rating) == 4.3 and r.review_count == 1234
    assert r.brand == "Dell" and r.model_name == "Inspiron 3520" and r.color == "Black" and r.weight == "1.8 kg"
    assert r.delivery_date == "Friday, 12 January"
    assert r.dimensions == "35 cm x 24 cm x 2 cm"
    assert [float(x) for x in (r.rating_5_star_percent, r.rating_1_star_percent)] == [60.0, 5.0]
    assert r.image_urls == ["https://m.media-amazon.com/a.jpg", "https://m.media-amazon.com/b.jpg"]
    assert "https://www.youtube.com/watch?v=abcdefghijk" in r.video_urls
    assert r.category == "Computers, Laptops"
    assert r.inventory_status == "In stock" and r.offers == "-17%"
    assert r.highlights == "Intel Core i5 processor, 16 GB RAM"
    assert r.seller_name == "Cocoblu Retail" and r.currency_code == "INR"
    assert r.delivery_price == "Free"
    assert r.technical_details["Brand"] == "Dell" and "Blank" not in r.technical_details
    v = df.select(pg.variants("html")).first()[0]
    assert [(x.name, x.asin) for x in v] == [("Black", "B0VARBLACK"), ("Silver", "B0VARSILVR")]


def test_jsonld_object_brand_and_list_images(spark):
    df = pages_df(spark, [(2, "https://www.croma.com/samsung-s24/p/300123", CROMA_JSONLD, "croma")])
    j = pg.jsonld_product(df).first()
    assert (j.title, j.brand, j.sale_price, j.list_price, j.rating, j.review_count) == (
        "Samsung Galaxy S24", "Samsung", 74999.0, 79999.0, 4.4, 321)
    assert j.image_urls == ["https://img.croma.com/1.jpg", "https://img.croma.com/2.jpg"]
    r = pg.page_products(df).first()
    assert r.title == "Samsung Galaxy S24" and r.description == "A phone"  # JSON-LD before <title> and markup
    assert r.brand == "Samsung" and float(r.price) == 79999.0 and float(r.sale_price) == 74999.0


def test_string_brand_and_swapped_prices(spark):
    df = pages_df(spark, [(3, "https://www.reliancedigital.in/lg-tv/p/49123", RD_SWAP, "reliancedigital")])
    j = pg.jsonld_product(df).first()
    assert j.brand == "LG" and j.image_urls == ["https://rd.com/tv.jpg"]
    r = pg.page_products(df).first()
    assert r.title == "LG TV 55"  # this platform reads JSON-LD first
    assert (float(r.price), float(r.sale_price)) == (65000.0, 59990.0)


def test_histogram_from_counts_and_flipkart_breadcrumb(spark):
    df = pages_df(spark, [(4, "https://www.flipkart.com/redmi/p/itm123", FLIPKART_COUNTS, "flipkart")])
    hist = df.select(pg.star_histogram("html")).first()[0]
    assert [float(x) for x in hist] == [60.0, 20.0, 10.0, 5.0, 5.0]
    r = pg.page_products(df).first()
    assert r.category == "Mobiles" and r.title == "Redmi Note 13"
    assert [float(x) for x in (r.rating_5_star_percent, r.rating_4_star_percent, r.rating_1_star_percent)] == [60.0, 20.0, 5.0]
    assert (float(r.price), float(r.sale_price)) == (20999.0, 17999.0)


def test_search_cards_sponsored_and_positions(spark):
    df = pages_df(spark, [(5, "https://www.amazon.in/s?k=laptop", SEARCH_PAGE, "amazon")])
    items = pg.search_items(df).orderBy("ordinal").collect()
    assert [(i.sku, i.is_sponsored) for i in items] == [
        ("B000000001", False), ("B000000002", True), ("B000000003", False), ("B000000004", True), ("B000000005", False)]
    assert items[0].title == "Organic one"
    ranked = (pg.search_items(df).withColumn("keyword_id", F.lit(1)).withColumn("page", F.lit(1))
              .withColumn("created_at", F.lit(dt.datetime(2024, 1, 1))).withColumnRenamed("ordinal", "item_id"))
    pos = sorted((r.sku, r.position) for r in rk.organic_position(ranked).collect())
    assert pos == [("B000000001", 1), ("B000000003", 2), ("B000000005", 3)]


def test_review_blocks(spark):
    df = pages_df(spark, [(6, "https://www.amazon.in/product-reviews/B0TEST", REVIEWS_PAGE, "amazon")])
    rows = {r.reviewer_name: r for r in pg.page_reviews(df, asof=dt.date(2024, 3, 1)).collect()}
    # amazon reviews only need a review id (FIL15), so the block without text is kept
    assert set(rows) == {"Asha", "Ravi", "NoText"}
    assert rows["NoText"].review_text is None and rows["NoText"].rating is None
    a = rows["Asha"]
    assert a.review_id == "R1ABCDEF" and float(a.rating) == 4.0 and a.review_title == "Great laptop"
    assert a.review_date == dt.date(2024, 1, 15) and a.verified_purchase and a.helpful_count == 12
    assert a.variant_info == "Colour: Black" and a.sentiment == "positive"
    b = rows["Ravi"]
    assert b.helpful_count == 1 and not b.verified_purchase and b.sentiment == "negative"


def test_card_links(spark):
    df = pages_df(spark, [(7, "https://blinkit.com/cn/milk", BLINKIT_CARDS, "blinkit")])
    links = [r.link for r in pg.card_links(df).orderBy("ordinal").collect()]
    assert links == ["https://blinkit.com/prn/amul-taaza-milk-500-ml/prid/101",
                     "https://blinkit.com/prn/britannia-bread/prid/102"]


def test_product_links_path_filter_and_cap(spark):
    html = "".join(f'<a href="/item-{i}/dp/B00000000{i % 10}">x</a>' for i in range(60)) + '<a href="/help">h</a>'
    df = pages_df(spark, [(8, "https://www.amazon.in/s?k=x", html, "amazon")])
    links = pg.product_links(df, limit=50).collect()
    assert len(links) == 50 and all("/dp/" in r.link for r in links)
    assert links[0].link.startswith("https://www.amazon.in/item-0/")


def test_title_cascade_fallbacks(spark):
    df = pages_df(spark, [(9, "u", '<meta property="og:title" content="Only Meta Title">', "croma"),
                          (10, "u", "<h1>abc</h1><title>Long enough title</title>", "croma")])
    got = dict(df.select("page_id", pg.cascade("html", pg.TITLE_RULES, 3)).collect())
    assert got == {9: "Only Meta Title", 10: "Long enough title"}


def test_whole_text_of_nested_elements(spark):
    deep = "<div>" * 400 + "deep" + "</div>" * 400
    html = (f'<div id="productDescription"><p><b>Light</b> and fast.{deep} <i>part</i> <span></span></p></div>'
            '<div id="availability"><span><div>In <span>stock</span></div> <span>today</span></span></div><div>after</div>')
    df = pages_df(spark, [(1, "https://www.amazon.in/dp/B0TESTTEST", html, "amazon"),
                          (2, "u", '<div id="productDescription"><p>never <div> closed <b>x</b></div> tail', "amazon"),
                          (3, "u", '<div id="productDescription"><p>' + "word <i>x</i> " * 50_000 + "</div>", "amazon"),
                          (4, "u", None, "amazon"), (5, "u", "", "amazon"), (6, "u", "<h1>Plain title</h1>", None), (7, "u", "\x01<h1>\x01</h1>", "no such")])
    page = rd.with_page(df, "fields")
    got = {r.page_id: (r.d, r.a, r.t) for r in page.select("page_id", rd.value("description").alias("d"), rd.availability().alias("a"), rd.value("title").alias("t")).collect()}
    assert got[1][:2] == ("Light and fast.deep part", "In stock today")
    assert got[2][0] == "never closed x tail"        # an element that never closes ends with the page
    assert got[3][0] == " ".join(["word x"] * 50_000)
    assert got[4] == got[5] == (None, "Unknown", None) and got[6] == (None, "Unknown", "Plain title") and got[7][1] == "Unknown"


def test_review_body_keeps_what_follows_inner_tags(spark):
    html = ('<div data-hook="review" id="R1"><span class="a-profile-name">A</span>'
            '<span data-hook="review-body">Good <b>screen</b> and <span>long</span> battery</span></div>')
    assert pg.page_reviews(pages_df(spark, [(1, "u", html, "amazon")])).first().review_text == "Good screen and long battery"


PLATFORM_PAGES = {
    "vijaysales": """<div class="product-name"><h1>Mixer <b>500 W</b></h1></div><div class="product__price--deatils d-none"><b data-final-price="1" data-mrp="2"></b></div>
<div class="product__price--deatils"><div><b data-final-price="2499" data-mrp="3999.5"></b></div></div><p class="instock__text d-none">a</p>
<div class="product__title--stats"><span>4.1 (12 Ratings &amp; 7 Reviews)</span></div><div class="product__title--reviews-star" data-rating-summary="4.1"></div>
<div class="productspecification"><ul><li><span class="panel-list-key">Brand</span> <span class="panel-list-value">Bajaj</span></li><li><span class="panel-list-key">Colour</span><span class="panel-list-value">White</span></li></ul></div>
<div class="accordion-item"><ul><li><span class="panel-list-key">Net Weight</span><span class="panel-list-value">2 kg</span></li></ul></div>
<div class="product__keyfeatures"><ul class="product__keyfeatures--list"><li>Two <ul><li>jars</li></ul></li><li>Steel</li></ul></div>
<p class="product__tags--label d-none">Old</p><p class="product__tags--label">New Arrival</p><p class="delivery__text">Free delivery by 12 January, 2024</p>""",
    "reliancedigital": """<h1 class="title">Fridge</h1><div class="selling-price">₹ 31,000</div><div class="mrp-price">₹35,000</div><button data-testid="add-to-cart">ADD TO CART</button>
<ul id="specification"><li class="specifications-list"><span>Seller <i>name</i></span><span class="specifications-list--right"><ul><li>Big Shop</li></ul></span></li>
<li class="specifications-list"><span>MODEL</span><span class="specifications-list--right"><ul><li>X-<b>100</b></li></ul></span></li><li class="specifications-list"><span>Width</span><span class="specifications-list--right"><ul><li>60 cm</li></ul></span></li>
<li class="specifications-list"><span>Height</span><span class="specifications-list--right"><ul><li>170 cm</li></ul></span></li></ul><div class="product-long-description"><p>Cools.</p><p>Saves power.</p></div>
<div class="delivery-fulfilment"><h5 class="delivery-section--header">Delivery by 14 Jan</h5></div><div class="rd-feedback-service-progress-row"><b class="rd-feedback-service-rating-text">5</b> <b class="rd-feedback-service-rating-count">30</b></div>
<div class="rd-feedback-service-progress-row"><b class="rd-feedback-service-rating-text">1</b> <b class="rd-feedback-service-rating-count">10</b></div><table class="flix-std-specs-table"><tr><th>Colour<td>Grey</table>""",
    "croma": """<h1 class="pd-title">Phone 12</h1><div class="cp-price main-product-price"><span class="new-price"><span class="amount">₹74,999</span></span></div><div class="cp-price discount"><span class="old-price"><span class="amount">₹79,999</span></span></div>
<div class="cp-rating"><span>4.4</span><span class="text"><a class="pr-review">(321 Reviews)</a></span></div><ul class="cp-specification-spec-info"><li class="cp-specification-spec-title"><h4>Brand</h4></li><li class="cp-specification-spec-details">Samsung</li></ul>
<div class="cp-breadcrumb"><ul class="list"><li><a>Phones</a></li><li><a>Smart</a></li></ul></div><div class="barAndStar"><b class="star-text">5 star</b><div class="bar-container"><div style="width: 70%"></div></div></div>""" + "".join(
        f'<div class="barAndStar"><b class="star-text">{i} star</b><div class="bar-container"><div style="width: {w}%"></div></div></div>' for i, w in ((4, 15), (3, 5), (2, 5), (1, 5))),
    "blinkit": """<div class="tw-text-400 tw-font-bold">Milk 500 ml</div><div class="tw-text-200 tw-font-semibold">₹2,800</div><div class="tw-text-200 tw-font-regular tw-line-through">₹3,000</div><button><span>ADD</span></button>
<div class="tw-text-050 tw-font-bold tw-uppercase">8 mins</div><table><tr><th>Brand</th><td>Amul</td></tr></table>""",
    "bigbasket": """<div class="prod-details"><h1>Rice</h1><span class="weight">5 kg</span></div><div class="price"><span class="currency">₹</span><span class="discnt-price">₹ 4,100</span></div>
<table class="spec-table"><tr><th>Unit Weight</th><td>5 kg</td></tr><tr><td>Dimensions</td><td>10 x 20</td></tr></table><nav class="breadcrumb"><a>Food</a><a>Grains</a></nav><button qa="add-to-cart">Add</button>""",
    "meesho": """<h1 class="x-title-y">Cotton Saree</h1><span class="price">₹4,990</span><span>Color: <b>Red</b></span><span class="rating">4.0</span><p class="breadcrumb"><a>Women</a><a>Sarees</a></p>
<div class="seller-info">Asha Store</div><span class="seller-rating">4.4</span><ul class="highlights"><li>Soft</li><li>Light</li></ul>""",
    "flipkart": """<div class="v1zwn21j v1zwn26">Redmi Note</div><div class="grid-formation-dynamic"><div><div class="v1zwn21l v1zwn27">Color</div></div><div class="v1zwn21k v1zwn26">Deep blue and something</div></div>
<table class="n7infM"><tr><td>Brand</td><td><ul><li>Redmi</li></ul></td></tr></table><div style="color:red;text-decoration: line-through">₹20,999</div><span class="x Nx9bqj y">₹17,999</span><div class="a-rating-b"><span>4.2</span></div>
<a href="/x/ratings-reviews/y"><i>12,000 ratings | 1,500 reviews</i></a><div data-observerid="1"><a href="/x/p/itmabc">v</a></div><div class="faikzn"><a>Home</a><a>Mobiles</a></div>""",
}


def test_records_of_the_other_platforms(spark):
    df = pages_df(spark, [(i, "https://x.in/p/1", h, p) for i, (p, h) in enumerate(PLATFORM_PAGES.items())])
    r = {x.platform: x for x in rd.page_products(df).collect()}
    v = r["vijaysales"]
    assert (v.title, float(v.sale_price), float(v.price), float(v.rating), v.review_count) == ("Mixer 500 W", 2499.0, 3999.5, 4.1, 7)
    assert (v.brand, v.color, v.weight, v.inventory_status) == ("Bajaj", "White", "2 kg", "Out of Stock")
    assert v.highlights == "Two jars | Steel" and v.delivery_price == "Free" and v.delivery_date == "12 January, 2024"
    d = r["reliancedigital"]
    assert (d.title, float(d.price), float(d.sale_price), d.inventory_status, d.seller_name, d.model_name) == ("Fridge", 35000.0, 31000.0, "In Stock", "Big Shop", "X-100")
    assert (d.dimensions, d.color, d.description, d.delivery_date) == ("60 cm x 170 cm", "Grey", "Cools. Saves power.", "14 Jan")
    assert [float(d[f"rating_{i}_star_percent"]) for i in (5, 4, 1)] == [75.0, 0.0, 25.0]
    c = r["croma"]
    assert (c.title, float(c.sale_price), float(c.price), c.review_count, c.brand, c.category) == ("Phone 12", 74999.0, 79999.0, 321, "Samsung", "Phones , Smart")
    assert [float(c[f"rating_{i}_star_percent"]) for i in (5, 4, 3)] == [70.0, 15.0, 5.0]
    b = r["blinkit"]
    assert (b.title, float(b.sale_price), float(b.price), b.inventory_status, b.brand) == ("Milk 500 ml", 2800.0, 3000.0, "In Stock", "Amul")
    g = r["bigbasket"]
    assert (g.title, float(g.sale_price), g.weight, g.dimensions, g.inventory_status) == ("Rice", 4100.0, "5 kg", "10 x 20", "In Stock")
    m = r["meesho"]
    assert (m.title, float(m.price), m.color, m.category, m.seller_name, m.highlights) == ("Cotton Saree", 4990.0, "Color Red", "Sarees", "Asha Store", "Soft, Light")
    f = r["flipkart"]
    assert (f.title, float(f.sale_price), float(f.price), float(f.rating), f.review_count, f.brand, f.category) == ("Redmi Note", 17999.0, 20999.0, 4.2, 1500, "Redmi", "Mobiles")


def test_search_cards_and_reviews_of_the_other_platforms(spark):
    pages = [
        (1, "u", '<div data-id="A"><a href="/x/p/itmA1?fm=organic" title="One">x</a></div><div data-id="B"><div class="IxWX8O"></div><a href="/x/p/itmB1?fm=organic">Two</a></div><div data-id="C"><a href="/x/p/itmC1?fm=neo">Three</a></div>', "flipkart"),
        (2, "u", '<a href="/x/p/77"><h3>Seven</h3></a><a href="/x/p/78"><h3>Eight</h3><i class="ad-badge"></i></a>', "reliancedigital"),
        (3, "u", '<div class="productCard"><a href="/s/p/9k"><h2>Nine</h2></a></div>', "meesho"), (4, "u", "<p>nothing</p>", "croma")]
    got = [(r.page_id, r.ordinal, r.sku, r.title, r.is_sponsored) for r in pg.search_items(pages_df(spark, pages)).orderBy("page_id", "ordinal").collect()]
    assert got == [(1, 1, "itmA1", "One", False), (1, 2, "itmB1", "Two", True), (1, 3, "itmC1", "Three", True), (2, 1, "77", "Seven", False), (2, 2, "78", "Eight", True), (3, 1, "9k", "Nine", False)]
    reviews = [
        (1, "u", '<ul class="list"><li class="list-item" id="q1"><h4>Fine</h4><p>Good<li class="list-item"><p>Bad <i class="star filled"></i><i class="star filled"></i></ul>', "croma"),
        (2, "u", '<div class="customer-review"><b class="customer-name">Om</b><b class="star-rating">3.5 stars</b><p>Okay one</p></div>', "vijaysales"),
        (3, "u", '<div class="col-12-12"><p class="_2sc7ZR _2V5EHH">Jo</p><a href="/r?reviewId=ab-12">l</a><div class="_3LWZlK">5</div><div class="t-ZTKy">Very goodREAD MORE</div><p class="zJ1ZGa">2 months ago</p></div>', "flipkart")]
    rows = {(r.page_id, r.ordinal): r for r in pg.page_reviews(pages_df(spark, reviews), asof=dt.date(2024, 3, 1)).collect()}
    assert (rows[1, 1].review_id, rows[1, 1].review_text, rows[1, 1].rating) == ("CROMA_q1", "Good", None)
    assert float(rows[1, 2].rating) == 2.0 and rows[1, 2].sentiment == "negative" and rows[1, 2].review_id.startswith("CROMA_")
    assert float(rows[2, 1].rating) == 3.5 and rows[2, 1].reviewer_name == "Om"
    assert (rows[3, 1].review_id, rows[3, 1].review_text, rows[3, 1].review_date) == ("ab-12", "Very good", dt.date(2024, 1, 1))


def test_platform_link_rules(spark):
    pages = [(1, "u", '<div data-cy="title-recipe"><a href="/a/dp/B01">x</a></div><div data-cy="title-recipe"><i><a href="/b/dp/B02">no child</a></i></div><a class="a-link-normal s-no-outline" href="/dp/B03">y</a><a href="/dp/B04">z</a>', "amazon"),
             (2, "u", '<a href="/product/x?a=1">x</a><a href="/product/x?a=2">x</a><div class="product-card"><a href="/p/9">not read: the first rule had links</a></div>', "reliancedigital"),
             (3, "u", '<div class="product-card"><a href="https://www.croma.com/a/p/1">1</a></div>', "croma"), (4, "u", "<a href='/help'>h</a>", "flipkart")]
    got = {}
    for r in rd.product_links(pages_df(spark, pages)).orderBy("page_id", "ordinal").collect():
        got.setdefault(r.page_id, []).append(r.link)
    assert got == {1: ["https://www.amazon.in/a/dp/B01", "https://www.amazon.in/dp/B03"], 2: ["https://www.reliancedigital.in/product/x"], 3: ["https://www.croma.com/a/p/1"]}


def test_jsonld_graph_and_nested_products(spark):
    def script(body):
        return f'<script type="application/ld+json">{body}</script>'
    df = pages_df(spark, [
        (1, "u", script('{"@graph":[{"@type":"WebPage","name":"w"},{"@type":["Thing","Product"],"name":"In graph"}]}'), "croma"),
        (2, "u", script('{"@type":"ItemList","itemListElement":[{"@type":"Product","name":"Nested"}]}'), "croma"),
        (3, "u", script('not json') + script(' [{"@type":"Product","name":"Listed"}]'), "croma")])
    assert {(r.page_id, r.title) for r in pg.jsonld_product(df).collect()} == {(1, "In graph"), (3, "Listed")}


def test_links_have_no_cap(spark):
    html = "".join(f'<a href="/p/{i}">x</a>' for i in range(120))
    df = pages_df(spark, [(1, "https://www.flipkart.com/c", html, "flipkart")])
    assert pg.product_links(df).count() == 120 and pg.product_links(df, limit=50).count() == 50
