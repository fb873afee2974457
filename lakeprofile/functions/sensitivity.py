"""Categories of sensitive columns, from names and what a sample looks like."""

from __future__ import annotations

import re

CATEGORIES = ("personal_name", "postal_address", "geolocation", "date_of_birth", "national_id", "financial_account", "credential", "health", "demographic", "employment", "contact", "online_identifier")
_STRONG = {
    "personal_name": "first_name last_name full_name surname given_name family_name maiden_name middle_name",
    "geolocation": "latitude longitude lat lon lng geolocation coordinates",
    "date_of_birth": "birth_date date_of_birth dob birthday birthdate",
    "national_id": "ssn social_security national_id passport passport_number tax_id",
    "financial_account": "iban account_number card_number credit_card bank_account routing_number",
    "credential": "password passwd secret api_key access_token refresh_token private_key credential",
    "health": "diagnosis medication blood_type allergy disability medical_record",
    "demographic": "gender sex ethnicity race religion nationality marital_status",
    "employment": "salary wage job_title employer income",
    "contact": "email phone mobile telephone fax email_address phone_number",
    "online_identifier": "ip_address mac_address device_id cookie_id user_agent advertising_id",
}
_WEAK = {"personal_name": "name contact_name customer_name", "postal_address": "address street street_address postal_address home_address", "national_id": "identity_number", "credential": "token hash key"}
_SHAPES = {"geolocation": {"latlon"}, "financial_account": {"card_number", "iban"}, "credential": {"jwt"}, "contact": {"email", "phone"}, "online_identifier": {"ip", "mac_address"}}
_PERSON = re.compile(r"^[A-Z][a-z'’-]+(?: [A-Z][a-z'’.-]+){1,2}$")
_COMPANY = re.compile(r"\b(?:Inc|Ltd|LLC|GmbH|Corp|Company|Group|Bank|University)\b")
_SSN = re.compile(r"^(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$")


def snake(name: str) -> str:
    """A name in lower snake case."""
    parted = re.sub(r"([a-z0-9])([A-Z])|([A-Z]+)([A-Z][a-z])", lambda m: f"{m[1] or m[3]}_{m[2] or m[4]}", name)
    return re.sub(r"[^a-z0-9]+", "_", parted.lower()).strip("_")


def _ends(name: str, tokens: str) -> bool:
    return any(name == t or name.endswith("_" + t) for t in tokens.split())


def is_person(value: str) -> bool:
    return bool(_PERSON.match(value)) and not _COMPANY.search(value)


def is_street(value: str) -> bool:
    return any(c.isdigit() for c in value) and len(value.split()) >= 2


def is_ssn(value: str) -> bool:
    return bool(_SSN.match(value))


def sensitivity(name: str, sample: list[str] = (), shapes: dict[str, float] | None = None, boolean: bool = False) -> str | None:
    """The first category that the column's name, or the shares of shapes in its sample, speak for."""
    if boolean:
        return None
    n, shapes = snake(name), shapes or {}
    share = lambda test: sum(map(test, sample)) / len(sample) if sample else 0.0
    for category in CATEGORIES:
        if _ends(n, _STRONG.get(category, "")) or sum(shapes.get(s, 0) for s in _SHAPES.get(category, ())) >= 0.5:
            return category
        if not _ends(n, _WEAK.get(category, "")) or any(_ends(n, t) for t in _STRONG.values()):
            continue  # a weak token says nothing beside another category's strong one
        if category == "personal_name" and share(is_person) >= 0.5 or category == "national_id" and share(is_ssn) >= 0.5:
            return category
        if category == "postal_address" and (not sample or share(is_street) >= 0.5):
            return category
        if category == "credential" and n in _WEAK["credential"].split() and shapes.get("hex", 0) + shapes.get("jwt", 0) >= 0.5:
            return category
    return None
