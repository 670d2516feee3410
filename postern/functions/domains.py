"""Host names: public suffixes, registered domains, addresses."""

from __future__ import annotations

import ipaddress
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The system's copy of the public suffix list; its place is a parameter of everything that reads it.
SUFFIX_LIST = os.environ.get("POSTERN_SUFFIX_LIST", "/usr/share/publicsuffix/public_suffix_list.dat")


@lru_cache(maxsize=4)
def load_rules(path: str = SUFFIX_LIST) -> frozenset[str] | None:
    """The list's ICANN rules (wildcards as *.x, exceptions as !x), None where there is no list."""
    if not os.path.exists(path):
        return None
    rules = set()
    with open(path, encoding="utf-8") as f:
        for line in f:
            line = line.strip()
            if "===END ICANN DOMAINS===" in line:
                break
            if line and not line.startswith("//"):
                rule = line.split()[0].lower()
                rules.add(rule)
                if not rule.isascii():
                    rules.add(".".join(p if p in ("*",) else _ascii(p) for p in rule.split(".")))
    return frozenset(rules)


def _ascii(label: str) -> str:
    try:
        return label.encode("idna").decode("ascii")
    except UnicodeError:
        return label


def is_ip(host: str | None) -> bool:
    try:
        ipaddress.ip_address((host or "").strip("[]"))
    except ValueError:
        return False
    return True


def split_host(host: str | None, rules: frozenset[str] | None) -> tuple[str, str, str]:
    """(subdomain, domain, suffix). An unknown top level has no suffix; an IPv4 address is a domain alone.

    Without rules the last label is the suffix.
    """
    host = (host or "").strip().strip(".").lower()
    labels = host.split(".")
    if not host:
        return "", "", ""
    if rules is None:
        return (".".join(labels[:-2]), labels[-2], labels[-1]) if len(labels) > 1 else ("", host, "")
    if is_ip(host) and ":" not in host:
        return "", host, ""
    cut = len(labels)
    for k in range(len(labels)):
        rest = ".".join(labels[k:])
        if "!" + rest in rules:
            cut = k + 1
            break
        if rest in rules or "*." + ".".join(labels[k + 1 :]) in rules and k + 1 < len(labels):
            cut = k
            break
    head, suffix = labels[:cut], ".".join(labels[cut:])
    return (".".join(head[:-1]), head[-1], suffix) if head else ("", "", suffix)


def registered_domain(host: str | None, rules: frozenset[str] | None) -> str:
    """Domain and suffix; '' for addresses and for a bare suffix; the domain alone where no suffix is known."""
    if is_ip(host):
        return ""
    _, domain, suffix = split_host(host, rules)
    return f"{domain}.{suffix}" if domain and suffix else domain


def domain_of(address: str | None) -> str:
    return address.rsplit("@", 1)[-1].strip().strip(">").lower() if address and "@" in address else ""


def split_udf(path: str = SUFFIX_LIST):
    """Arrow-batched split_host: struct<subdomain, domain, suffix, registered, is_ip>; each distinct host of a batch once."""
    rules = load_rules(path)

    @F.pandas_udf("subdomain string, domain string, suffix string, registered string, is_ip boolean")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for hosts in batches:
            known = {h: (*split_host(h, rules), registered_domain(h, rules), is_ip(h)) for h in hosts.unique()}
            yield pd.DataFrame([known[h] for h in hosts], columns=["subdomain", "domain", "suffix", "registered", "is_ip"])

    return split


def address_domain(address: Column) -> Column:
    """What follows the last @, '' without one (native form of `domain_of`)."""
    return F.when(F.contains(address, F.lit("@")), F.lower(F.rtrim(F.btrim(F.substring_index(address, "@", -1)), F.lit(">")))).otherwise(F.lit(""))


def is_ipv4(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$")
