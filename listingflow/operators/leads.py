"""Ranking, lists and statistics over leads. ``as_of`` is always an argument."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingflow.functions.normalize import address_from_listing
from listingflow.operators.dedup import richness

OPEN = ("called_no_answer", "talked", "callback", "meeting")
CLOSED = ("dnc", "lost", "contract")


def latest_listings(listings: DataFrame, limit: int = 20, private_only: bool = False) -> DataFrame:
    rows = listings.where("is_active")
    if private_only:
        rows = rows.where("seller_type = 'private' and phone_e164 is not null")
    return rows.orderBy(F.desc("first_seen_at"), "id").limit(limit).select(
        "id", "source", "deal_type", "city", "price", "phone_e164", "seller_type", "first_seen_at", F.substring("title", 1, 40).alias("title"),
    )


def in_scope(df: DataFrame, cities: tuple[str, ...], districts: tuple[str, ...] = ()) -> DataFrame:
    """Listings of these cities and districts; an unknown place passes."""
    from listingflow.functions.normalize import fold

    out = df.where(F.col("city").isNull() | fold(F.col("city")).isin([fold(F.lit(c)) for c in cities]))
    if districts:
        out = out.where(F.col("district").isNull() | fold(F.col("district")).isin([fold(F.lit(d)) for d in districts]))
    return out


def age_days(t: Column, as_of: Column) -> Column:
    """Whole elapsed days, towards zero."""
    return ((F.unix_timestamp(as_of) - F.unix_timestamp(t)) / 86400).cast("int")


def primary_listings(listings: DataFrame) -> DataFrame:
    """One callable listing a group: the oldest, then richest, then least id."""
    rows = listings.where("is_active and seller_type <> 'agency' and phone_e164 is not null")
    group = F.coalesce("dedup_group", F.concat(F.lit("id:"), F.col("id").cast("string")))
    order = Window.partitionBy("grp").orderBy("first_seen_at", F.desc(richness(("price", "area_m2", "rooms", "street"))), "id")
    return rows.withColumn("grp", group).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "grp")


def last_calls(call_log: DataFrame) -> DataFrame:
    """(lead_id, last_called_at, had_callback, n_calls) over all history."""
    return call_log.groupBy("lead_id").agg(
        F.max("called_at").alias("last_called_at"), F.bool_or(F.col("outcome") == "callback").alias("had_callback"),
        F.count(F.lit(1)).alias("n_calls"),
    )


def opener_for(age: Column, has_history: Column) -> Column:
    return F.when(has_history, "B").when(age >= 10, "C").otherwise("A")


def lead_score(overdue: Column, age: Column, seller: Column, phone: Column, called_days: Column, had_callback: Column) -> Column:
    """Overdue 100, fresh 40, private 30, unknown 5, old 15, phone 10; zero while
    a call is under 14 days old, unless overdue or ever called back."""
    cool = ~overdue & called_days.isNotNull() & (called_days < 14) & ~F.coalesce(had_callback, F.lit(False))
    points = F.when(overdue, 100).otherwise(0) + F.when(age <= 0, 40).otherwise(0) + F.when(seller == "private", 30).when(seller == "unknown", 5).otherwise(0)
    points = points + F.when(age >= 10, 15).otherwise(0) + F.when(phone.isNotNull(), 10).otherwise(0)
    return F.when(cool, 0).otherwise(points)


def today_list(listings: DataFrame, contacts: DataFrame, leads: DataFrame, call_log: DataFrame, as_of: Column, limit: int = 15) -> DataFrame:
    """The leads to call now, best first. A lead whose listing is not primary
    stays only with a next step, and then counts as fresh and unknown."""
    people = contacts.where("not do_not_call").select(F.col("id").alias("contact_id"), "name", F.col("phone_e164").alias("phone"))
    homes = primary_listings(listings).select(
        F.col("id").alias("listing_id"), F.lit(True).alias("primary"), "seller_type", "deal_type", F.col("first_seen_at").alias("seen"), "city",
        "price",
    )
    rows = leads.where(~F.col("status").isin(*CLOSED)).join(people, "contact_id").join(homes, "listing_id", "left").join(
        last_calls(call_log).withColumnRenamed("lead_id", "id"), "id", "left",
    )
    rows = rows.where("primary or next_step_at is not null")
    age = F.coalesce(age_days(F.col("seen"), as_of), F.lit(0))
    overdue = F.coalesce(F.col("next_step_at") <= as_of, F.lit(False))
    rows = rows.withColumns(
        {"age_days": age, "overdue": overdue, "seller": F.coalesce("seller_type", F.lit("unknown")), "deal": F.coalesce("deal_type", F.lit("sale"))}
    )
    called = age_days(F.col("last_called_at"), as_of)
    score = lead_score(F.col("overdue"), F.col("age_days"), F.col("seller"), F.col("phone"), called, F.col("had_callback"))
    out = rows.withColumn("score", score).where("score > 0")
    return out.select(
        F.col("id").alias("lead_id"), F.coalesce("name", F.lit("właściciel")).alias("name"), "phone", "status", F.col("deal").alias("deal_type"),
        F.col("seller").alias("seller_type"), "age_days", "overdue", "score", opener_for(F.col("age_days"), F.col("last_called_at").isNotNull()).alias("opener"),
    ).orderBy(F.desc("score"), "age_days", "lead_id").limit(limit)


def today_counter(daily_stats: DataFrame, as_of: Column, target: int = 10) -> DataFrame:
    """Today's numbers, or zeros; one row."""
    today = daily_stats.where(F.col("day") == F.to_date(as_of)).agg(
        F.max("calls_made").alias("c"), F.max("target").alias("t"), F.max("meetings_booked").alias("m"),
    )
    rows = today.select(
        F.coalesce("c", F.lit(0)).alias("calls_made"), F.coalesce("t", F.lit(target)).alias("target"),
        F.coalesce("m", F.lit(0)).alias("meetings_booked"),
    )
    return rows.withColumn(
        "progress", F.least(F.lit(100), F.floor(100 * F.col("calls_made") / F.greatest(F.lit(1), F.col("target")) + 0.5)).cast("int"),
    )


def list_leads(
    leads: DataFrame, contacts: DataFrame, listings: DataFrame, call_log: DataFrame, as_of: Column, status: str | None = None, limit: int = 200,
) -> DataFrame:
    """Leads in progress (or of one status), the next due first."""
    rows = leads.where(F.col("status") == status if status else F.col("status").isin(*OPEN))
    people = contacts.where("not do_not_call").select(F.col("id").alias("contact_id"), "name", "phone_e164")
    homes = listings.select(F.col("id").alias("listing_id"), "title")
    calls = call_log.groupBy(F.col("lead_id").alias("id")).agg(F.count(F.lit(1)).alias("calls"))
    out = rows.join(people, "contact_id").join(homes, "listing_id", "left").join(calls, "id", "left")
    overdue = F.coalesce(F.col("next_step_at") <= as_of, F.lit(False))
    out = out.select(
        F.col("id").alias("lead_id"), "status", "name", "phone_e164", "title", "next_step", "next_step_at", "updated_at", overdue.alias("overdue"),
        F.coalesce("calls", F.lit(0)).alias("calls"),
    )
    return out.orderBy(F.asc_nulls_last("next_step_at"), F.desc("updated_at"), "lead_id").limit(limit)


def daily_stats_between(daily_stats: DataFrame, days: int, as_of: Column) -> DataFrame:
    """Days after as_of minus so many, in order; 1 to 365."""
    if not 1 <= days <= 365:
        raise ValueError("days must be 1 to 365")
    return daily_stats.where(F.col("day") > F.date_sub(F.to_date(as_of), days)).orderBy("day")


def opener_breakdown(call_log: DataFrame, days: int, as_of: Column) -> DataFrame:
    """Calls, talks and meetings by opener in the window, and the rate of success."""
    rows = call_log.where(F.col("opener_used").isNotNull() & (F.col("called_at") >= as_of - F.make_interval(days=F.lit(days))))
    sums = rows.groupBy(F.col("opener_used").alias("opener")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("outcome").isin("talked", "meeting")).alias("talked"),
        F.count_if(F.col("outcome") == "meeting").alias("meetings"),
    )
    return sums.withColumn("success_pct", F.floor(100 * F.col("meetings") / F.col("calls") + 0.5).cast("int"))


def calendar(meetings: DataFrame, leads: DataFrame, contacts: DataFrame, listings: DataFrame, start: Column, end: Column, as_of: Column) -> DataFrame:
    """Meetings and callbacks from start to before end, in order of time."""
    people = contacts.select(
        F.col("id").alias("contact_id"), F.coalesce("name", F.lit("właściciel")).alias("name"), F.col("phone_e164").alias("phone"),
    )
    own = leads.select(F.col("id").alias("lead_id"), "contact_id", "listing_id", "status", "next_step", "next_step_at")
    met = meetings.where((F.col("starts_at") >= start) & (F.col("starts_at") < end)).withColumnRenamed("id", "entry_id").join(
        own.select("lead_id", "contact_id", "listing_id"), "lead_id",
    ).join(people, "contact_id")
    homes = listings.select(
        F.col("id").alias("listing_id"), F.col("url").alias("listing_url"), "price",
        address_from_listing(F.col("street"), F.col("district"), F.col("city")).alias("home"),
    )
    met = met.join(homes, "listing_id", "left").select(
        F.lit("meeting").alias("kind"), "entry_id", "lead_id", "name", "phone", F.col("starts_at").alias("at"), "address", "note", "listing_url",
        "price", "outcome",
    )
    back = own.where(
        (F.col("status") == "callback") & (F.col("next_step_at") >= start) & (F.col("next_step_at") < end)
    ).join(people, "contact_id").join(homes, "listing_id", "left")
    back = back.select(
        F.lit("callback").alias("kind"), F.col("lead_id").alias("entry_id"), "lead_id", "name", "phone", F.col("next_step_at").alias("at"),
        F.col("home").alias("address"), F.col("next_step").alias("note"), "listing_url", "price", F.lit(None).cast("string").alias("outcome"),
    )
    return met.unionByName(back).withColumn("past", F.col("at") < as_of).orderBy("at", "kind", "entry_id")


def calendar_days(entries: DataFrame) -> DataFrame:
    """Entries a UTC day, with those to close and those planned."""
    close = (F.col("kind") == "meeting") & F.col("past") & F.col("outcome").isNull()
    return entries.groupBy(F.to_date("at").alias("day")).agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(close).alias("to_close"),
        F.count_if(~F.col("past") | F.col("outcome").isNull()).alias("planned"),
    )


def meeting_stats(meetings: DataFrame, min_sample: int = 20) -> DataFrame:
    """Closed meetings and contracts; a rate only from a large enough sample."""
    one = meetings.agg(F.count("outcome").alias("closed"), F.count_if(F.col("outcome") == "contract").alias("contracts"))
    enough = F.col("closed") >= min_sample
    return one.withColumn("enough", enough).withColumn(
        "rate_pct", F.when(F.col("enough"), F.floor(100 * F.col("contracts") / F.col("closed") + 0.5).cast("int")),
    )
