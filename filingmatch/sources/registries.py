"""The five registries that carry an industry code."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import fixed_values as V
from .. import schemas as S
from ..functions.cells import day, lookup
from ..functions.core import blank_to_null, nonempty, no_strings, strip, text, title_case
from ..functions.mail import email_kind
from ..functions.names import (code_is_it, flat, is_distinct_name, label_is_it, looks_like_company, number_is_it, tidy_address,
                               tidy_name)
from ..functions.people import person_name
from ..functions.phones import norm_phone
from ..functions.places import clean_zip, state_from_zip
from .spec import FILING_COLUMNS, SourceSpec, register

def _no_extra() -> Column:
    return F.create_map().cast("map<string,string>")


def _or(c: Column | str, fallback: Column | str) -> Column:
    """The value, or the fallback when it is missing or empty."""
    return F.coalesce(blank_to_null(c), F.lit(fallback) if isinstance(fallback, str) else fallback, F.lit(""))


def _filing(df: DataFrame, source: str, rid: Column, tie: Column, **values: Column) -> DataFrame:
    """Filings of one source from expressions over its raw rows; what is not given is empty. Newest first wins an id."""
    given: dict[str, Column] = {
        "trade_name": F.lit(""), "entity_type": F.lit(""), "individual": F.lit(False), "industry": F.lit(""), "phone": F.lit(""),
        "emails": no_strings(), "coded": F.lit(True), "extra": _no_extra(), **values,
        "id": F.concat(F.lit(source + ":"), rid), "source": F.lit(source)}
    first = F.struct(F.coalesce(-F.unix_date(given["registered"]), F.lit(2**31 - 1)).alias("age"), tie.alias("tie"))
    return df.select(*[given[c].alias(c) for c in FILING_COLUMNS], first.alias("_first"))


def _trade(name: Column, other: Column) -> Column:
    return F.when(is_distinct_name(name, other), tidy_name(other)).otherwise(F.lit(""))


# ------------------------------------------------------------------------------------------------------------------ Texas
def _tx_scan(since: date, until: date) -> Column:
    d = F.col("outlet_permit_issue_date")
    return (d >= since.isoformat()) & (d <= until.isoformat() + "T00:00:00.000") & number_is_it("outlet_naics_code")


def _tx(raw: DataFrame) -> DataFrame:
    legal, outlet = strip(text("taxpayer_name")), strip(text("outlet_name"))
    org = text("taxpayer_organization_type")
    naics = F.coalesce(F.col("outlet_naics_code").cast("string"), F.lit(""))
    kept = raw.where((org != "IS") | looks_like_company(outlet))                 # sole owners need a business name
    return _filing(
        kept, "tx", F.concat(text("taxpayer_number"), F.lit("-"), text("outlet_number")), legal,
        name=tidy_name(_or(legal, outlet)), trade_name=_trade(legal, outlet), entity_type=lookup(V.TX_ORG, org, org),
        individual=org == "IS", state=F.upper(_or("outlet_state", "TX")), city=title_case("outlet_city"),
        address=tidy_address("outlet_address"), zip=clean_zip("outlet_zip_code"), registered=day("outlet_permit_issue_date"),
        naics=naics, industry=F.concat(F.lit("Sales-tax permit, NAICS "), naics))


# ------------------------------------------------------------------------------------------------------------ Connecticut
def _ct_scan(since: date, until: date) -> Column:
    d = F.col("date_registration")
    return (d >= since.isoformat()) & (d <= until.isoformat() + "T23:59:59") & label_is_it("naics_code")


def _ct(raw: DataFrame) -> DataFrame:
    code = text("naics_code")
    coded = code.rlike(V.LABELLED_CODE)
    mail = F.lower(strip(text("business_email_address")))
    return _filing(
        raw, "ct", _or("accountnumber", F.col("id")), F.col("id"),
        name=tidy_name("name"), entity_type=text("business_type"), state=F.upper(_or("billingstate", "CT")),
        city=title_case("billingcity"), address=tidy_address("billingstreet"), zip=clean_zip("billingpostalcode"),
        registered=day("date_registration"), naics=F.regexp_extract(code, V.LABELLED_CODE, 2),
        industry=strip(F.when(coded, F.regexp_extract(code, V.LABELLED_CODE, 1)).otherwise(code)),
        emails=F.when(email_kind(mail).isin("own", "free"), F.array(mail)).otherwise(no_strings()),
        extra=F.create_map(F.lit("business_id"), text("id")))


def officers(children: DataFrame) -> DataFrame:
    """Officers as child rows of their business, with the key that orders them. They stay rows: a business with officers
    without end is never one array."""
    both = F.concat_ws(" ", blank_to_null(strip(text("firstname"))), blank_to_null(strip(text("lastname"))))
    name = _or(both, strip(text("name__c")))
    return (children.withColumn("_n", name).where(nonempty("_n"))
            .select("business_id", "create_dt", "name__c", tidy_name("_n").alias("name"),
                    title_case(strip(text("designation"))).alias("title")))


def first_officers(children: DataFrame) -> DataFrame:
    """The first officer of each business whose name is a person's: what a filing keeps of them. An aggregate with map-side
    combine, so a business that owns a third of all officers is no hot task."""
    named = officers(children).withColumn("_person", person_name("name", registry=True)).where(F.col("_person").isNotNull())
    first = F.min_by(F.struct("name", "title"), F.struct("create_dt", "name__c", "name", "title"))
    return named.groupBy("business_id").agg(first.alias("person"))


#: Officers that a filing lists at most, beside the first one whose name is a person's.
PEOPLE_LISTED = 50


def with_people(filings: DataFrame, children: DataFrame, most: int = PEOPLE_LISTED) -> DataFrame:
    """Connecticut filings with their officers in the order of appointment (`create_dt, name__c`): the first `most`, and after them the first
    whose name is a person's if it is not among those, so whatever looks for a person finds the same one as in the whole list. The limit holds
    before the shuffle too: a business with officers without end sends `most` rows per task."""
    order = ["create_dt", "name__c", "name", "title"]
    ranked = officers(children).withColumn("_n", F.row_number().over(Window.partitionBy("business_id").orderBy(*order))).where(F.col("_n") <= most)
    listed = ranked.groupBy("business_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "name", "title"))), lambda x: F.struct(x["name"].alias("name"), x["title"].alias("title"))).alias("_listed"))
    both = listed.join(first_officers(children), "business_id", "left")
    people = F.when(F.col("person").isNull() | F.array_contains("_listed", F.col("person")), F.col("_listed")).otherwise(F.array_append("_listed", F.col("person")))
    found = both.select(F.col("business_id").alias("_bid"), people.alias("people"))
    joined = filings.withColumn("_bid", F.try_element_at("extra", F.lit("business_id"))).join(found, "_bid", "left")
    return joined.select(*filings.columns, F.coalesce("people", F.array().cast("array<struct<name:string,title:string>>")).alias("people"))


# ---------------------------------------------------------------------------------------------------------------- Seattle
def _seattle_scan(since: date, until: date) -> Column:
    return F.col("license_start_date").between(since.strftime("%Y%m%d"), until.strftime("%Y%m%d")) & code_is_it("naics_code")


def _seattle(raw: DataFrame) -> DataFrame:
    legal, trade = strip(text("business_legal_name")), strip(text("trade_name"))
    sole = F.lower(text("ownership_type")).startswith("sole")
    kept = raw.where(~sole | ((trade != "") & (flat(trade) != flat(legal))))
    name = F.when(sole, trade).otherwise(legal)
    d = text("license_start_date")
    dashed = F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))
    return _filing(
        kept, "seattle", _or("city_account_number", _or("ubi", flat(name))), F.concat_ws(" ", name, trade),
        name=tidy_name(name), trade_name=_trade(name, trade), entity_type=text("ownership_type"), individual=sole,
        state=F.upper(_or("state", "WA")), city=title_case("city"), address=tidy_address("street_address"), zip=clean_zip("zip"),
        registered=F.when(F.length(d) >= 8, day(dashed)), naics=text("naics_code"), industry=text("naics_description"),
        phone=norm_phone("business_phone"), extra=F.create_map(F.lit("ubi"), text("ubi")))


# ---------------------------------------------------------------------------------------------------------- San Francisco
def _start_scan(code: str):
    def scan(since: date, until: date) -> Column:
        return F.col("location_start_date").between(since.isoformat() + "T00:00:00", until.isoformat() + "T23:59:59") & code_is_it(code)

    return scan


def _sf(raw: DataFrame) -> DataFrame:
    owner, dba = strip(text("ownership_name")), strip(text("dba_name"))
    company = looks_like_company(owner)
    name = F.when(company, owner).otherwise(dba)
    naics = text("self_reported_naics_code")
    return _filing(
        raw.where(company | (dba != "")), "sf", _or("uniqueid", F.col("ttxid")), F.concat_ws(" ", name, F.col("ttxid")),
        name=tidy_name(name), trade_name=F.when(company, _trade(name, dba)).otherwise(F.lit("")),
        entity_type=F.when(company, "Company").otherwise("Individual"), individual=~company, state=F.upper(_or("state", "CA")),
        city=title_case(_or("city", "San Francisco")), address=tidy_address("full_business_address"), zip=clean_zip("business_zip"),
        registered=day("location_start_date"), naics=naics, industry=F.concat(F.lit("NAICS "), naics))


# ------------------------------------------------------------------------------------------------------------ Los Angeles
def _la(raw: DataFrame) -> DataFrame:
    legal, dba = strip(text("business_name")), strip(text("dba_name"))
    company = looks_like_company(legal)
    located = state_from_zip(raw.where(company | (dba != "")), "zip_code", "_state")
    return _filing(
        located, "la", _or("location_account", flat(legal)), F.concat_ws(" ", legal, dba), name=tidy_name(legal), trade_name=_trade(legal, dba),
        entity_type=F.when(company, "Company").otherwise("Individual"), individual=~company, state=_or("_state", "CA"),
        city=title_case(_or("city", "Los Angeles")), address=tidy_address("street_address"), zip=clean_zip("zip_code"),
        registered=day("location_start_date"), naics=text("naics"), industry=text("primary_naics_description"))


TEXAS = register(SourceSpec("tx", "Texas", S.TX, 21, _tx_scan, _tx))
CONNECTICUT = register(SourceSpec("ct", "Connecticut", S.CT, 7, _ct_scan, _ct))
SEATTLE = register(SourceSpec("seattle", "Seattle", S.SEATTLE, 7, _seattle_scan, _seattle))
SAN_FRANCISCO = register(SourceSpec("sf", "San Francisco", S.SF, 7, _start_scan("self_reported_naics_code"), _sf))
LOS_ANGELES = register(SourceSpec("la", "Los Angeles", S.LA, 45, _start_scan("naics"), _la))
