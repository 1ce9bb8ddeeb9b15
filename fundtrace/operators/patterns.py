"""Policy patterns over money, directors and lobbying (X1-X4, X6).

Conduits, pass-through chains, concentration over departments, lobbyists who direct funded charities, former office
holders who lobby their department, and contact before a sole-source award. Fiscal years are calendar years of the
dates. All joins are by equality: intervals are cut into years, and "the last one before" is a running value over sorted
rows, so no plan holds a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundtrace.functions import ids, names
from fundtrace.operators.directors import NAME, named_filings
from fundtrace.operators.edges import current_grants, linked, public_edges
from fundtrace.operators.entities import id_by_root
from fundtrace.session import checkpoint
from fundtrace.sources.warehouse import Warehouse

COOLING_YEARS = 5


def received_by_year(wh: Warehouse) -> DataFrame:
    """(bn, year, received): dated public money per business number."""
    money = public_edges(wh).filter("date IS NOT NULL")
    to = id_by_root(wh.entities, "to_entity_id", "bn")
    return (
        money.join(to, "to_entity_id")
        .groupBy("bn", F.year("date").alias("year"))
        .agg(F.sum("amount").alias("received"))
    )


def _gifts(wh: Warehouse) -> DataFrame:
    """(src, dst, year, total_gifts) of gifts between two numbers."""
    gifts = wh.gifts.filter("total_gifts > 0 AND donee_bn IS NOT NULL").select(
        ids.bn_left(F.col("bn")).alias("src"),
        ids.bn_left(F.col("donee_bn")).alias("dst"),
        F.year("fpe").alias("year"),
        "total_gifts",
    )
    return gifts.filter("src <> dst")


def gifts_by_year(wh: Warehouse) -> DataFrame:
    """(src, dst, year, amount) of gifts between two numbers."""
    return _gifts(wh).groupBy("src", "dst", "year").agg(F.sum("total_gifts").alias("amount"))


def _answering(gifts: DataFrame) -> DataFrame:
    """Gifts by the year of the money they may pass on: their own or the one before."""
    return gifts.withColumn("grant_year", F.explode(F.array("year", F.col("year") - 1))).groupBy("src", "dst", "grant_year").agg(F.sum("amount").alias("amount"))


def mutual_gifts(wh: Warehouse) -> DataFrame:
    """(a, b, year, onward, returned): two numbers that gave to each other in ``year`` or the next, from either side.

    Both directions of a pair are rows of one key, so the gifts are shuffled once, by pair: yearly sums, the pairs that gave
    both ways and the sums of two years all follow where the rows are.
    """
    gifts = _gifts(wh).filter("year IS NOT NULL").select(
        F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high"), (F.col("src") < F.col("dst")).alias("up"), "year", "total_gifts"
    )
    sums = [F.sum(F.when(F.col("up"), F.col("total_gifts"))).alias("up"), F.sum(F.when(~F.col("up"), F.col("total_gifts"))).alias("down")]
    yearly = gifts.repartition("low", "high").groupBy("low", "high", "year").agg(*sums)
    pair = Window.partitionBy("low", "high")
    both = yearly.withColumns({"_up": F.count("up").over(pair), "_down": F.count("down").over(pair)}).filter("_up > 0 AND _down > 0")
    met = (
        both.withColumn("grant_year", F.explode(F.array("year", F.col("year") - 1)))
        .groupBy("low", "high", F.col("grant_year").alias("year"))
        .agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        .filter("up IS NOT NULL AND down IS NOT NULL")
    )

    def side(a: str, b: str, onward: str, returned: str) -> Column:
        return F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col("year"), F.col(onward).alias("onward"), F.col(returned).alias("returned"))

    return met.select(F.inline(F.array(side("low", "high", "up", "down"), side("high", "low", "down", "up"))))


def _holders(wh: Warehouse) -> DataFrame:
    return named_filings(wh).filter(F.col(NAME) != "").select("bn_root", NAME).distinct()


def with_shared_directors(wh: Warehouse, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with the number of director names both numbers have filed.

    Names are looked up for the pairs, so nobody is paired for a common name.
    """
    held, keys = _holders(wh), pairs.select("a", "b").distinct()
    at_a = held.select(F.col("bn_root").alias("a"), NAME)
    at_b = held.select(F.col("bn_root").alias("b"), NAME)
    counts = keys.join(at_a, "a").join(at_b, ["b", NAME]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared_directors"))
    return pairs.join(counts, ["a", "b"], "left").withColumn("shared_directors", F.coalesce("shared_directors", F.lit(0)))


def conduits(wh: Warehouse, min_share: float = 0.5, min_shared: int = 1) -> DataFrame:
    """(a, b, year, received, onward, returned, shared_directors): round trips of public money.

    ``a`` received public money in ``year``, gave at least ``min_share`` of it to ``b`` in that or the next year, and got
    money back from ``b`` in these two years; both share ``min_shared`` directors or more.
    """
    money = received_by_year(wh).withColumnRenamed("bn", "a")
    # Mutual giving is rare, so it is found before the public money is looked up.
    found = mutual_gifts(wh).join(money, ["a", "year"])
    # Stored, because the directors are looked up for its pairs before they are joined to it.
    found = checkpoint(found.filter(F.col("onward").cast("double") >= F.lit(min_share) * F.col("received").cast("double")))
    found = with_shared_directors(wh, found).filter(F.col("shared_directors") >= min_shared)
    return found.select("a", "b", "year", *[F.col(c).cast("double").alias(c) for c in ("received", "onward", "returned")], "shared_directors")


def pass_through(wh: Warehouse, min_share: float = 0.7, min_shared: int = 1) -> DataFrame:
    """(a, b, c, year, received, passed_on, reached, share, shared_directors): chains that keep most of the money.

    ``a`` received public money in ``year``; in that or the next year ``a`` gave to ``b`` and ``b`` to ``c``, each at
    least ``min_share`` of it; ``a`` and ``b`` share ``min_shared`` directors or more. ``share`` is the lesser gift's.
    The first gift is cut by share and directors before it meets the second.
    """
    gifts = _answering(gifts_by_year(wh))
    enough = lambda amount: F.col(amount).cast("double") >= F.lit(min_share) * F.col("received").cast("double")
    first = gifts.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("grant_year").alias("year"), F.col("amount").alias("passed_on"))
    first = first.join(received_by_year(wh).withColumnRenamed("bn", "a"), ["a", "year"]).filter(enough("passed_on"))
    first = with_shared_directors(wh, first).filter(F.col("shared_directors") >= min_shared)
    second = gifts.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("grant_year").alias("year"), F.col("amount").alias("reached"))
    found = first.join(second, ["b", "year"]).filter(F.col("c") != F.col("a")).filter(enough("reached"))
    least = F.least(F.col("passed_on").cast("double"), F.col("reached").cast("double"))
    return found.select(
        "a", "b", "c", "year", *[F.col(c).cast("double").alias(c) for c in ("received", "passed_on", "reached")],
        (least / F.col("received").cast("double")).alias("share"), "shared_directors",
    )


def _department_grants(wh: Warehouse) -> DataFrame:
    """(entity_id, bn, department, year, amount) of current federal agreements with a department."""
    grants = current_grants(wh).filter("agreement_value > 0 AND owner_org IS NOT NULL")
    links = linked(wh, "fed", "grants_contributions", "_id", "bigint").select("entity_id", "_key").distinct()
    to = id_by_root(wh.entities, "entity_id", "bn")
    return links.join(grants, F.col("_key") == F.col("_id")).join(to, "entity_id").select(
        "entity_id", "bn", F.col("owner_org").alias("department"), F.year("agreement_start_date").alias("year"), F.col("agreement_value").alias("amount")
    )


def department_concentration(wh: Warehouse, min_departments: int = 3, above: float = 500_000) -> DataFrame:
    """(bn, year, departments, total): numbers paid by several departments in one year, over ``above`` in all."""
    grants = _department_grants(wh).filter("year IS NOT NULL")
    # Departments first: few rows per number and year are left for the second step.
    each = grants.groupBy("bn", "year", "department").agg(F.sum("amount").alias("amount"))
    found = each.groupBy("bn", "year").agg(F.count(F.lit(1)).alias("departments"), F.sum("amount").alias("total"))
    return found.filter((F.col("departments") >= min_departments) & (F.col("total") > above)).select("bn", "year", "departments", F.col("total").cast("double").alias("total"))


def _paid(wh: Warehouse) -> DataFrame:
    """(bn, department, total) over all years."""
    return _department_grants(wh).groupBy("bn", "department").agg(F.sum("amount").alias("total"))


def _person() -> Column:
    return names.director_norm(F.col("first_name"), F.col("last_name")).alias("person")


def _registrations(wh: Warehouse) -> DataFrame:
    rows = wh.table("lobby_registrations").select("registration_id", _person(), ids.bn_left(F.col("client_bn")).alias("client"), "department", "filed_on")
    return rows.filter("person <> '' AND department IS NOT NULL")


def lobbyist_charities(wh: Warehouse) -> DataFrame:
    """(person, client, department, charity, registrations, client_total, charity_total): one department, both sides.

    A person is registered to lobby a department for a client that it pays, and directs a charity that it pays too. The
    cycle person - client - department - charity is cut down by semi-joins before any two of its long sides meet.
    """
    paid = _paid(wh)
    lobbied = _registrations(wh).groupBy("person", "client", "department").agg(F.countDistinct("registration_id").alias("registrations"))
    lobbied = lobbied.join(paid.select(F.col("bn").alias("client"), "department", F.col("total").alias("client_total")), ["client", "department"])
    directed = _holders(wh).select(F.col(NAME).alias("person"), F.col("bn_root").alias("charity"))
    directed = directed.join(lobbied.select("person").distinct(), "person", "left_semi")
    held = directed.join(paid.select(F.col("bn").alias("charity"), "department", F.col("total").alias("charity_total")), "charity")
    found = lobbied.join(held, ["person", "department"])
    return found.select("person", "client", "department", "charity", "registrations", *[F.col(c).cast("double").alias(c) for c in ("client_total", "charity_total")])


def revolving_door(wh: Warehouse, years: int = COOLING_YEARS) -> DataFrame:
    """(person, department, ended_on, registration_id, client, filed_on, client_total): lobbying one's former department.

    Registrations filed after an office ended and within ``years`` of it, for clients the department pays. An office is
    dealt out to the years it reaches into, and joins the registrations of such a year.
    """
    offices = wh.table("former_offices").select(_person(), "department", "ended_on").filter("person <> '' AND ended_on IS NOT NULL").distinct()
    until = F.add_months("ended_on", 12 * years)
    offices = offices.withColumn("until", until).withColumn("_year", F.explode(F.sequence(F.year("ended_on"), F.year("until"))))
    filed = _registrations(wh).withColumn("_year", F.year("filed_on"))
    found = filed.join(offices, ["person", "department", "_year"]).filter("filed_on > ended_on AND filed_on <= until")
    paid = _paid(wh).select(F.col("bn").alias("client"), "department", F.col("total").cast("double").alias("client_total"))
    return found.join(paid, ["client", "department"]).select("person", "department", "ended_on", "registration_id", "client", "filed_on", "client_total")


def contact_before_award(wh: Warehouse, within_days: int | None = None) -> DataFrame:
    """(award_id, vendor, department, awarded_on, amount, contact_id, person, contacted_on, days): the last contact before a sole-source award.

    Contacts and awards of a vendor and department stand in one sorted stream, in which the latest contact runs along:
    one value is held however many there are. A contact on the day of the award does not precede it. Of contacts on
    one day the one with the largest id counts.
    """
    contacts = wh.table("lobby_contacts").filter("contacted_on IS NOT NULL AND department IS NOT NULL").select(
        ids.bn_left(F.col("client_bn")).alias("vendor"), "department", F.col("contacted_on").alias("day"), F.lit(1).alias("after"),
        F.struct("contact_id", _person(), "contacted_on").alias("contact"), F.lit(None).cast("struct<award_id:string,amount:decimal(18,2)>").alias("award"),
    )
    awards = wh.table("department_awards").filter("sole_source_reason IS NOT NULL AND awarded_on IS NOT NULL").select(
        ids.bn_left(F.col("vendor_bn")).alias("vendor"), "department", F.col("awarded_on").alias("day"), F.lit(0).alias("after"),
        F.lit(None).cast(contacts.schema["contact"].dataType).alias("contact"), F.struct("award_id", "amount").alias("award"),
    )
    vendors = awards.select("vendor", "department").distinct()
    stream = contacts.join(vendors, ["vendor", "department"], "left_semi").unionByName(awards)
    # Awards of a day stand before its contacts.
    order = Window.partitionBy("vendor", "department").orderBy("day", "after", "contact.contact_id").rowsBetween(Window.unboundedPreceding, 0)
    found = stream.withColumn("latest", F.last("contact", ignorenulls=True).over(order)).filter("award IS NOT NULL AND latest IS NOT NULL")
    days = F.date_diff("day", "latest.contacted_on")
    if within_days is not None:
        found = found.filter(days <= within_days)
    return found.select(
        "award.award_id", "vendor", "department", F.col("day").alias("awarded_on"), F.col("award.amount").alias("amount"),
        "latest.contact_id", "latest.person", "latest.contacted_on", days.alias("days"),
    )
