"""Raw portal payloads to raw listings: JSON batches, page state, HTML."""

import html as html_lib
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listingflow.functions.lineage import broadcast_if_small

# Markers and labels of the portals.
STATE_MARKERS = ("window.__PRERENDERED_STATE__=", "__PRERENDERED_STATE__ =", "__NEXT_DATA__")
PRIVATE_WORDS = ("osoba prywatna", "prywatne", "private")
BUSINESS_WORDS = ("firma", "business", "biuro", "deweloper")
ROOMS = {"ONE": 1, "TWO": 2, "THREE": 3, "FOUR": 4, "FIVE": 5, "SIX": 6, "SEVEN": 7, "EIGHT": 8, "NINE": 9, "TEN": 10}
FLOORS = {
    "CELLAR": -1, "GROUND": 0, "FIRST": 1, "SECOND": 2, "THIRD": 3, "FOURTH": 4, "FIFTH": 5, "SIXTH": 6, "SEVENTH": 7, "EIGHTH": 8, "NINTH": 9,
    "TENTH": 10
}
RAW = "source string, source_id string, url string, deal_type string, title string, description string, price_raw string, area_raw string, rooms_raw string, floor_raw string, location_raw string, phone_raw string, seller_label string, posted_at_raw string, has_phone boolean"
HINTS = {
    "area": re.compile(r"\d+(?:[.,]\d+)?\s*m", re.I), "rooms": re.compile(r"\bpoko|kawalerka", re.I),
    "floor": re.compile("piętro|parter|suterena", re.I)
}
NEXT_DATA = r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>'


def _v(path: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get(ad, '{path}', '{kind}')")


def _shape(path: str) -> Column:
    return F.expr(f"schema_of_variant(try_variant_get(ad, '{path}', 'variant'))")


def _text(path: str) -> Column:
    """A non-empty string or number at a path, as text."""
    return F.nullif(F.when(_shape(path).rlike("^(STRING|BIGINT|DECIMAL|DOUBLE)"), _v(path)), F.lit(""))


def offer_fields(ads: DataFrame) -> DataFrame:
    """Raw listings of rows (source, deal_type, ad variant); no url or id: no row.

    Parameters become a map, the last of a key wins. Fields that are boolean or
    text in turn are told apart by the variant's own type.
    """
    params = F.expr(
        "transform(try_variant_get(ad, '$.params', 'array<variant>'), p -> struct("
        "coalesce(try_variant_get(p, '$.key', 'string'), try_variant_get(p, '$.name', 'string')) as k,"
        "coalesce(try_variant_get(p, '$.value.label', 'string'), try_variant_get(p, '$.value.value', 'string'), try_variant_get(p, '$.value.key', 'string')) as v))"
    )
    rows = ads.withColumn("ps", F.coalesce(params, F.array().cast("array<struct<k:string,v:string>>")))
    param = lambda key: F.expr(f"try_element_at(filter(ps, p -> p.k = '{key}'), -1).v")
    price = [_text(f"$.price.{a}{b}") for a in ("displayValue", "value", "regularPrice", "amount") for b in ("", ".value", ".amount")]
    scalar = F.when(~_shape("$.price").startswith("OBJECT"), _text("$.price"))
    flag = lambda path, yes, no: F.when(_shape(path) == "BOOLEAN", F.when(_v(path, "boolean"), yes).otherwise(no))
    label = F.coalesce(
        *(F.coalesce(flag(f"$.{k}", F.lit("firma"), F.lit("osoba prywatna")), _text(f"$.{k}")) for k in ("business", "sellerType", "seller_type", "user_label"))
    )
    label = F.coalesce(
        label, flag("$.user.isBusiness", F.lit("firma"), F.lit("osoba prywatna")), F.when(_text("$.user.company_name").isNotNull(), "firma"),
    )
    phone = F.when(_shape("$.contact.phone") == "BOOLEAN", None).otherwise(_text("$.contact.phone"))
    has_phone = F.coalesce(F.when(_shape("$.contact.phone") == "BOOLEAN", _v("$.contact.phone", "boolean")), phone.isNotNull())
    url = _text("$.url")
    url = F.when(url.startswith("/"), F.concat(F.lit("https://www.olx.pl"), url)).otherwise(url)
    source_id = F.coalesce(_text("$.id"), F.nullif(F.regexp_extract(url, r"-ID([0-9A-Za-z]+)\.html", 1), F.lit("")))
    place = F.nullif(F.concat_ws(", ", _text("$.location.city.name"), _text("$.location.district.name"), _text("$.location.region.name")), F.lit(""))
    out = rows.select(
        "source", source_id.alias("source_id"), url.alias("url"), "deal_type", _text("$.title").alias("title"), _text("$.description").alias("description"),
        F.coalesce(param("price"), *price, scalar).alias("price_raw"), param("m").alias("area_raw"), param("rooms").alias("rooms_raw"), param("floor_select").alias("floor_raw"),
        place.alias("location_raw"), phone.alias("phone_raw"), label.alias("seller_label"), F.coalesce(_text("$.created_time"), _text("$.last_refresh_time")).alias("posted_at_raw"), has_phone.alias("has_phone"),
    )
    return out.where("url is not null and source_id is not null")


def parse_offers_api(payloads: DataFrame) -> DataFrame:
    """Raw listings of (source, deal_type, payload) rows with JSON of offers.

    A payload that is no object, or whose data is no list, gives no rows.
    """
    ads = payloads.select(
        "source", "deal_type", F.explode(F.expr("try_variant_get(try_parse_json(payload), '$.data', 'array<variant>')")).alias("ad"),
    )
    return offer_fields(ads.where(F.expr("schema_of_variant(ad)").startswith("OBJECT")))


def _states(text: str) -> Iterator[object]:
    for marker in STATE_MARKERS:
        for m in re.finditer(re.escape(marker), text):
            rest = text[m.end() :]
            start = re.search(r'["{]', rest if marker != "__NEXT_DATA__" else rest[rest.find(">") :])
            if not start:
                continue
            at = start.start() + (0 if marker != "__NEXT_DATA__" else rest.find(">"))
            try:
                value, _ = json.JSONDecoder().raw_decode(rest[at:])
                yield json.loads(value) if isinstance(value, str) else value
            except (ValueError, RecursionError):
                continue


def _longest_ads(value: object) -> list[dict]:
    best: list[dict] = []
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            ads = [x for x in v if isinstance(x, dict) and ".html" in str(x.get("url") or "") and x.get("id") and isinstance(x.get("title"), str)]
            if len(ads) > len(best):
                best = ads
            todo += v
        elif isinstance(v, dict):
            todo += v.values()
    return best


def extract_page_state(pages: DataFrame) -> DataFrame:
    """Raw listings of (source, deal_type, html) rows whose page holds its state.

    The state is a tree of unknown depth, so it is walked in Python; its longest
    list of adverts goes on as JSON, and the page is dropped at once.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                ads = max((_longest_ads(s) for s in _states(r.html or "")), key=len, default=[])
                rows += [(r.source, r.deal_type, json.dumps(a)) for a in ads]
            yield pd.DataFrame(rows, columns=["source", "deal_type", "ad"])

    ads = pages.select("source", "deal_type", "html").mapInPandas(walk, "source string, deal_type string, ad string")
    return offer_fields(ads.select("source", "deal_type", F.expr("try_parse_json(ad)").alias("ad")))


_ITEM = "struct<id:string,slug:string,title:string,isPrivateOwner:boolean,areaInSquareMeters:double,roomsNumber:string,floorNumber:string,totalPrice:struct<value:double>,rentPrice:struct<value:double>,createdAtFirst:string,dateCreated:string,location:struct<address:struct<street:struct<name:string,number:string>,city:struct<name:string>,province:struct<name:string>>,reverseGeocoding:struct<locations:array<struct<locationLevel:string,name:string>>>>>"


def parse_next_data_search(pages: DataFrame) -> DataFrame:
    """Private offers of (source, deal_type, html) search pages, and the page count."""
    schema = f"struct<props:struct<pageProps:struct<data:struct<searchAds:struct<items:array<{_ITEM}>,pagination:struct<totalPages:int>>>>>>"
    state = pages.select(
        "source", "deal_type", F.from_json(F.regexp_extract("html", NEXT_DATA, 1), schema)["props"]["pageProps"]["data"]["searchAds"].alias("s"),
    )
    ads = state.select(
        "source", "deal_type", F.col("s.pagination.totalPages").alias("total_pages"), F.explode("s.items").alias("i"),
    ).where("i.isPrivateOwner and i.slug <> '' and i.id <> ''")
    pick = lambda table, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(c))
    # A total price of zero or less does not fall back to the rent.
    amount = F.when(F.col("i.totalPrice").isNotNull(), F.col("i.totalPrice.value")).otherwise(F.col("i.rentPrice.value"))
    district = F.expr("try_element_at(filter(i.location.reverseGeocoding.locations, x -> x.locationLevel = 'district'), 1).name")
    street = F.nullif(F.concat_ws(" ", "i.location.address.street.name", "i.location.address.street.number"), F.lit(""))
    street = F.when(street.rlike(r"(?i)^(ul\.|al\.|pl\.|os\.)\s"), street).otherwise(F.concat(F.lit("ul. "), street))
    return ads.select(
        "source", F.col("i.id").alias("source_id"), F.concat(F.lit("https://www.otodom.pl/pl/oferta/"), F.col("i.slug")).alias("url"), "deal_type", F.col("i.title").alias("title"),
        F.when(amount > 0, amount).alias("price_num"), F.col("i.areaInSquareMeters").alias("area_num"), pick(ROOMS, "i.roomsNumber").alias("rooms_num"), pick(FLOORS, "i.floorNumber").alias("floor_num"),
        F.concat_ws(", ", "i.location.address.city.name", district, street, "i.location.address.province.name").alias("location_raw"),
        F.lit("osoba prywatna").alias("seller_label"), F.coalesce("i.createdAtFirst", "i.dateCreated").alias("posted_at_raw"), "total_pages",
    )


def parse_next_data_offer(pages: DataFrame) -> DataFrame:
    """(source, source_id, phone, description, label) of (source, source_id, html)."""
    schema = "struct<props:struct<pageProps:struct<ad:struct<contactDetails:struct<phones:array<string>,type:string>,description:string>>>>"
    ad = pages.select("source", "source_id", F.from_json(F.regexp_extract("html", NEXT_DATA, 1), schema)["props"]["pageProps"]["ad"].alias("ad"))
    text = F.trim(F.regexp_replace(F.regexp_replace("ad.description", "<[^>]*>", " "), r"[\s ]+", " "))
    label = F.when(F.col("ad.contactDetails.type") == "private", "osoba prywatna").otherwise(F.col("ad.contactDetails.type"))
    return ad.select(
        "source", "source_id", F.try_element_at("ad.contactDetails.phones", F.lit(1)).alias("phone"), F.nullif(text, F.lit("")).alias("description"),
        label.alias("label"),
    )


class _Nodes(HTMLParser):
    """Text below nodes of interest: (attribute value, href, text) in order."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = []
        self.roots: list[dict] = []

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "attrs": dict(attrs), "kids": [], "text": ""}
        (self.stack[-1]["kids"] if self.stack else self.roots).append(node)
        if tag not in self.VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i]["tag"] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        if self.stack:
            self.stack[-1]["kids"].append({"tag": "#", "attrs": {}, "kids": [], "text": data})


def _walk(nodes: list[dict], skip: tuple[str, ...] = ()) -> Iterator[dict]:
    """All nodes in the order of the page; unclosed tags may nest them deeply."""
    todo = nodes[::-1]
    while todo:
        n = todo.pop()
        if n["tag"] not in skip:
            yield n
            todo += reversed(n["kids"])


def _find(nodes: list[dict], test) -> Iterator[dict]:
    return filter(test, _walk(nodes))


def _node_text(node: dict | None) -> str | None:
    if node is None:
        return None
    raw = " ".join(n["text"] for n in _walk([node], ("script", "style")))
    return re.sub(r"\s+", " ", raw).strip()


def _tree(html: str | None) -> list[dict]:
    p = _Nodes()
    p.feed(html or "")
    return p.roots


def _marked(*values: str):
    return lambda n: any(n["attrs"].get(a) in values for a in ("data-cy", "data-testid"))


def parse_listing_cards(pages: DataFrame) -> DataFrame:
    """Raw listings of the cards in (source, deal_type, html) pages, the way out
    when a page holds no state. A card without link or id is dropped."""

    def cards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                for card in _find(_tree(r.html), _marked("l-card")):
                    link = next(_find([card], lambda n: n["tag"] == "a" and n["attrs"].get("href")), None)
                    url = link["attrs"]["href"] if link else ""
                    number = re.search(r"-ID([0-9A-Za-z]+)\.html", url)
                    if not number:
                        continue
                    url = "https://www.olx.pl" + url if url.startswith("/") else url
                    first = lambda test, c=card: _node_text(next(_find([c], test), None))
                    place = first(_marked("location-date")) or ""
                    where, *later = place.split(" - ")
                    rows.append(
                        (r.source, number[1], url, r.deal_type, first(lambda n: n["tag"] in ("h4", "h6") or n["attrs"].get("data-cy") == "ad-card-title"), first(_marked("ad-price")), where.strip() or None, later[-1].strip() if later else None)
                    )
            yield pd.DataFrame(rows, columns=["source", "source_id", "url", "deal_type", "title", "price_raw", "location_raw", "posted_at_raw"])

    return pages.select("source", "deal_type", "html").mapInPandas(
        cards,
        "source string, source_id string, url string, deal_type string, title string, price_raw string, location_raw string, posted_at_raw string",
    )


def parse_offer_page(pages: DataFrame) -> DataFrame:
    """(page_id, description, label, phone, area_raw, rooms_raw, floor_raw)."""

    def offers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, html in zip(b["page_id"], b["html"], strict=True):
                roots = _tree(html)
                first = lambda test, roots=roots: _node_text(next(_find(roots, test), None)) or None
                label = first(_marked("trader-title", "seller_card"))
                if not label:
                    body = " ".join(filter(None, map(_node_text, roots))).lower()
                    label = "osoba prywatna" if any(w in body for w in PRIVATE_WORDS) else "firma" if any(w in body for w in BUSINESS_WORDS) else None
                tel = next(_find(roots, lambda n: (n["attrs"].get("href") or "").startswith("tel:")), None)
                phone = html_lib.unescape(tel["attrs"]["href"][4:]) if tel else first(_marked("contact-phone"))
                params = next(_find(roots, _marked("ad-parameters-container", "ad-parameters")), None)
                area = rooms = floor = None
                for t in map(_node_text, _find([params] if params else [], lambda n: n["tag"] in ("p", "li", "span"))):
                    if area is None and HINTS["area"].search(t):
                        area = t
                    elif rooms is None and HINTS["rooms"].search(t):
                        rooms = t
                    elif floor is None and HINTS["floor"].search(t):
                        floor = t
                rows.append((i, first(_marked("ad_description")), label, phone, area, rooms, floor))
            yield pd.DataFrame(rows, columns=["page_id", "description", "label", "phone", "area_raw", "rooms_raw", "floor_raw"])

    return pages.select("page_id", "html").mapInPandas(
        offers, "page_id long, description string, label string, phone string, area_raw string, rooms_raw string, floor_raw string",
    )


#: The parser of each kind of payload, and the column that it reads.
PARSERS = {"olx_api": parse_offers_api, "olx_page": extract_page_state, "olx_cards": parse_listing_cards, "otodom": parse_next_data_search}
_READS = {"olx_api": "payload"}


def read_payloads(spark: SparkSession, kind: str, path: str, per_line: bool = False) -> DataFrame:
    """Raw listings of a folder of payloads, parsed as their kind's.

    A payload is a file below source=.../deal_type=.../, which name its source and
    deal type; Spark lists and reads the files, so they may be in any store that
    it reads. With per_line it is a line of such a file, as JSON without line breaks
    may be: many payloads then need few files, which Spark splits as it likes. One
    that holds no listings gives no rows. Further kinds are entries of PARSERS.
    """
    files = spark.read.option("wholetext", not per_line).option("recursiveFileLookup", False).text(path)
    named = files.select(F.col("source").cast("string"), F.col("deal_type").cast("string"), F.col("value").alias(_READS.get(kind, "html")))
    return PARSERS[kind](named)


def enrich_with_offer_pages(raw: DataFrame, details: DataFrame) -> DataFrame:
    """Raw listings with what their offer pages say; the page's phone decides."""
    d = details.select(
        "source", "source_id", F.col("phone").alias("__p"), F.col("description").alias("__d"), F.col("label").alias("__l"),
        F.lit(True).alias("__hit"),
    )
    out = raw.join(d, ["source", "source_id"], "left")
    put = {
        "phone_raw": F.when(F.col("__hit"), F.col("__p")).otherwise(F.col("phone_raw")), "description": F.coalesce("__d", "description"),
        "seller_label": F.coalesce("__l", "seller_label")
    }
    return out.withColumns(put).drop("__p", "__d", "__l", "__hit")


def offers_to_visit(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """Raw listings without phone that are not stored with one."""
    known = stored.where("phone_e164 is not null").select("source", "source_id")
    return raw.where("phone_raw is null").join(known, ["source", "source_id"], "left_anti")


def first_seen_per_source_id(raw: DataFrame, arrival: str) -> DataFrame:
    """The first row of each (source, source_id) in order of arrival; what that
    leaves open is decided by a hash of the row, never by chance."""
    w = Window.partitionBy("source", "source_id").orderBy(arrival, F.xxhash64(*raw.columns))
    return raw.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def search_filter(listings: DataFrame, filters: DataFrame) -> DataFrame:
    """Listings inside a filter row (deal_type, city, price and area ranges).

    Area bounds are truncated. Unknown price or area does not pass. A filter
    table is a handful of parameters; its rows are counted before a broadcast.
    """
    f = broadcast_if_small(filters).alias("f")
    hit = (F.col("l.deal_type") == F.col("f.deal_type")) & (F.col("l.city") == F.col("f.city"))
    hit = hit & F.col("l.price").between(F.col("f.price_min"), F.col("f.price_max")) & F.col("l.area_m2").between(
        F.col("f.area_min").cast("int"), F.col("f.area_max").cast("int"),
    )
    return listings.alias("l").join(f, hit, "left_semi")
