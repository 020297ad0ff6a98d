"""Schemas of the landed and stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


TX = _strings("taxpayer_name", "outlet_name", "taxpayer_organization_type", "taxpayer_number", "outlet_number", "outlet_state",
              "outlet_city", "outlet_address", "outlet_zip_code", "outlet_permit_issue_date").add("outlet_naics_code", T.LongType())
CT = _strings("id", "accountnumber", "name", "business_type", "billingstreet", "billingcity", "billingstate", "billingpostalcode",
              "date_registration", "naics_code", "business_email_address")
CT_OFFICERS = _strings("business_id", "create_dt", "name__c", "firstname", "lastname", "designation")
SEATTLE = _strings("business_legal_name", "trade_name", "ownership_type", "city_account_number", "ubi", "street_address", "city",
                   "state", "zip", "license_start_date", "naics_code", "naics_description", "business_phone")
SF = _strings("uniqueid", "ttxid", "ownership_name", "dba_name", "full_business_address", "city", "state", "business_zip",
              "location_start_date", "self_reported_naics_code")
LA = _strings("location_account", "business_name", "dba_name", "street_address", "city", "zip_code", "location_start_date", "naics",
              "primary_naics_description")

PERSON = T.StructType([T.StructField("name", T.StringType()), T.StructField("title", T.StringType())])
CONTACT = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "title", "email", "linkedin", "from")])
TOPIC = T.StructType([T.StructField("level", T.StringType()), T.StructField("score", T.DoubleType())])

FILING = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("trade_name", T.StringType()), T.StructField("entity_type", T.StringType()),
    T.StructField("individual", T.BooleanType()), T.StructField("state", T.StringType()), T.StructField("city", T.StringType()),
    T.StructField("address", T.StringType()), T.StructField("zip", T.StringType()), T.StructField("registered", T.DateType()),
    T.StructField("naics", T.StringType()), T.StructField("industry", T.StringType()), T.StructField("phone", T.StringType()),
    T.StructField("emails", T.ArrayType(T.StringType())), T.StructField("people", T.ArrayType(PERSON)),
    T.StructField("coded", T.BooleanType()), T.StructField("extra", T.MapType(T.StringType(), T.StringType()))])

LOOKUP = T.StructType([
    T.StructField("checked", T.DateType()), T.StructField("website", T.StringType()), T.StructField("domain", T.StringType()),
    T.StructField("why", T.ArrayType(T.StringType())), T.StructField("created", T.DateType()), T.StructField("email", T.StringType()),
    T.StructField("email_from", T.StringType()), T.StructField("emails", T.ArrayType(T.StringType())),
    T.StructField("phone", T.StringType()), T.StructField("phone_from", T.StringType()),
    T.StructField("phones", T.ArrayType(T.StringType())), T.StructField("contact", CONTACT), T.StructField("linkedin", T.StringType()),
    T.StructField("linkedin_company", T.StringType()), T.StructField("it", TOPIC),
    T.StructField("missing", T.ArrayType(T.StringType())), T.StructField("dropped_because", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType())])

COMPANY = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("raw", FILING),
    T.StructField("enrich", LOOKUP), T.StructField("state", T.StringType()), T.StructField("first_seen", T.DateType()),
    T.StructField("attempts", T.IntegerType()), T.StructField("next_due", T.DateType()), T.StructField("domain", T.StringType()),
    T.StructField("pushed_hash", T.StringType()), T.StructField("pushed_at", T.DateType()), T.StructField("ready_at", T.DateType()),
    T.StructField("strikes", T.IntegerType())])

PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])

PUBLISHED = ["id", "company", "website", "email", "phone", "address", "registered", "contact", "contact_email", "linkedin",
             "linkedin_label", "industry", "state", "source", "fit", "proof"]
