"""Column functions that clean and classify handles, names and text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieledger.functions import words as W


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def clean_text(col: Column) -> Column:
    """Without NUL characters; unpaired surrogates cannot occur in Spark strings."""
    return F.regexp_replace(col, "\\x00", "")


def safe_slice(col: Column, n: int) -> Column:
    """The first n code points."""
    return F.substring(col, 1, n)


def normalize_phone(col: Column, default_cc: str = "91") -> Column:
    """``+digits``, or null: device suffixes go, 11 to 15 bare digits are international, 10 get the default country."""
    bare = F.regexp_replace(F.trim(col), r"(?i)@(s\.whatsapp\.net|lid|g\.us)$", "")
    digits = F.regexp_replace(bare, r"[^0-9]", "")
    return (
        F.when(bare.rlike(r"^\d{11,15}$"), F.concat(F.lit("+"), bare))
        .when(bare.rlike(r"^\+[0-9 ().-]+$") & F.length(digits).between(8, 15), F.concat(F.lit("+"), digits))
        .when(bare.rlike(r"^[0-9 ().-]+$") & (F.length(digits) == 10), F.concat(F.lit("+" + default_cc), digits))
    )


def canon_phone_nanp(col: Column) -> Column:
    """The address book's rule: 10 digits are North American, 11 that begin with 1 too, ``+`` is kept; else null."""
    digits = F.regexp_replace(F.trim(col), r"[^0-9]", "")
    return (
        F.when(F.length(digits) < 8, F.lit(None).cast("string"))
        .when(F.trim(col).startswith("+"), F.concat(F.lit("+"), digits))
        .when(F.length(digits) == 10, F.concat(F.lit("+1"), digits))
        .when((F.length(digits) == 11) & digits.startswith("1"), F.concat(F.lit("+"), digits))
    )


_EMAIL = r"^([^\s@]+)@([a-z0-9][a-z0-9.-]*\.[a-z]{2,})$"


def canonicalize_email(col: Column) -> Column:
    """struct (canonical, domain, valid): lower case, tag after ``+`` gone, dots of the gmail family gone."""
    low = F.lower(F.trim(col))
    domain, local = F.regexp_extract(low, _EMAIL, 2), F.regexp_replace(F.regexp_extract(low, _EMAIL, 1), r"\+.*$", "")
    gmail = domain.isin("gmail.com", "googlemail.com")
    local, domain = F.when(gmail, F.replace(local, F.lit("."), F.lit(""))).otherwise(local), F.when(gmail, F.lit("gmail.com")).otherwise(domain)
    shaped = F.coalesce(low.rlike(_EMAIL), F.lit(False))
    valid = shaped & (local != "")
    return F.struct(F.when(valid, F.concat_ws("@", local, domain)).alias("canonical"), F.when(shaped, domain).alias("domain"), F.coalesce(valid, F.lit(False)).alias("valid"))


_TOKENS = "|".join(W.BOT_TOKENS)
_LOCALS = "^(" + "|".join(W.BOT_LOCAL_PARTS) + ")$"
_SUBDOMAINS = "^(" + "|".join(W.BOT_SUBDOMAINS) + r")\."


def domain_class(domain: Column, local: Column | None = None, bots: tuple[str, ...] = W.BOT_DOMAINS) -> Column:
    """struct (class, confidence, evidence) by the first rule that holds; ``bots`` are the domains that are known to be bots'."""
    d, lp = F.lower(F.trim(domain)), F.lower(local if local is not None else F.lit(None).cast("string"))

    def out(kind: str, confidence: float, evidence: str) -> Column:
        return F.struct(F.lit(kind).alias("class"), F.lit(confidence).alias("confidence"), F.lit(evidence).alias("evidence"))

    return (
        F.when(d.isNull() | (d == ""), out("other", 0.0, "empty"))
        .when(lp.rlike(_LOCALS), out("bot", 0.85, "local part"))
        .when(lp.rlike(f"(^|[-_.])({_TOKENS})([-_.]|$)"), out("bot", 0.85, "token of the local part"))
        .when(d.isin(*bots), out("bot", 0.95, "bot list"))
        .when(d.rlike(_SUBDOMAINS), out("bot", 0.9, "bot subdomain"))
        .when(d.isin(*W.PERSONAL_DOMAINS), out("personal", 0.95, "personal list"))
        .when(d.isin(*W.SAAS_DOMAINS), out("saas", 0.9, "saas list"))
        .when(d.isin(*W.PRESS_DOMAINS), out("press", 0.9, "press list"))
        .when(d.endswith(".press") | d.endswith(".news"), out("press", 0.7, "top-level domain"))
        .when(d.rlike(r"^[a-z0-9][a-z0-9.-]*\.[a-z]{2,}$") & ~d.contains(".."), out("work", 0.6, "corporate shape"))
        .otherwise(out("other", 0.3, "no rule"))
    )


def is_bot_email(col: Column, bots: tuple[str, ...] = W.BOT_DOMAINS) -> Column:
    local, domain = F.split_part(col, F.lit("@"), F.lit(1)), F.split_part(col, F.lit("@"), F.lit(2))
    hit = domain.isin(*bots) | F.lower(local).rlike(_LOCALS) | F.lower(local).rlike(rf"(^|[-_.])({_TOKENS})(\b|[-_.]|$)") | F.lower(domain).rlike(_SUBDOMAINS)
    return F.coalesce(hit, F.lit(False))


def is_bulk_mail(headers: Column) -> Column:
    """Headers by lower-cased name: an unsubscribe or list header, or bulk precedence."""
    bulk = F.lower(F.coalesce(F.element_at(headers, "precedence"), F.lit(""))).contains("bulk")
    return F.coalesce(F.map_contains_key(headers, "list-unsubscribe") | F.map_contains_key(headers, "list-id") | bulk, F.lit(False))


def parse_addresses(col: Column) -> Column:
    """A header's address list -> array of struct (name, email); entries without an address go."""
    angle, bare = r'^\s*"?(.*?)"?\s*<([^>]+)>\s*$', r"([^\s<>@]+@[^\s<>@]+)"

    def one(part: Column) -> Column:
        t = F.trim(part)
        found = F.regexp_extract(t, bare, 1)
        email = F.when(t.rlike(angle), F.trim(F.regexp_extract(t, angle, 2))).otherwise(found)
        rest = F.trim(F.regexp_replace(F.trim(F.regexp_replace(t, bare, "")), r'^"|"$', ""))
        name = F.when(t.rlike(angle), F.trim(F.regexp_extract(t, angle, 1))).otherwise(rest)
        return F.struct(F.nullif(name, F.lit("")).alias("name"), F.nullif(email, F.lit("")).alias("email"))

    parts = F.split(F.coalesce(col, F.lit("")), r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.filter(F.transform(parts, one), lambda x: x["email"].isNotNull())


def _folded(col: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(col)), r"\s+", " ")


def strip_forwarded_name(name: Column, email: Column) -> Column:
    """A display name without its forwarding wrapper; a vendor's name on a foreign domain is null."""
    n = F.trim(name)
    wrap = r"(?i)^(.+?)\s+(?:via|on behalf of|through|for)\s+.+$"
    n = F.when(n.rlike(wrap), F.trim(F.regexp_extract(n, wrap, 1))).otherwise(n)
    paren = r"^(.+?)\s*\(([^)]+)\)\s*$"
    vendor_inside = _folded(F.regexp_extract(n, paren, 2)).isin(*W.VENDOR_DOMAINS)
    n = F.when(n.rlike(paren) & vendor_inside, F.trim(F.regexp_extract(n, paren, 1))).otherwise(n)
    domain = F.lower(F.regexp_extract(email, r"@([^@]*)$", 1))
    table = F.create_map(*[x for v, ds in W.VENDOR_DOMAINS.items() for x in (F.lit(v), F.array(*map(F.lit, ds)))])
    none = F.array().cast("array<string>")
    # the expressions are bound once as lambda variables, so that they are not repeated in the plan
    checked = F.transform(F.array(F.struct(n.alias("n"), _folded(n).alias("f"))), lambda x: F.struct(
        x["n"].alias("n"), F.coalesce(F.element_at(table, x["f"]), none).alias("own"), F.coalesce(F.element_at(table, F.replace(x["f"], F.lit(" "), F.lit(""))), none).alias("compact")))
    kept = F.transform(checked, lambda x: F.when(
        (x["n"] != "") & ((F.size(x["own"]) == 0) | F.exists(F.concat(x["own"], x["compact"]), lambda d: (domain == d) | domain.endswith(F.concat(F.lit("."), d)))), x["n"]))
    return F.when(~F.coalesce(F.trim(name).rlike(r"^<.*>$"), F.lit(True)), F.get(kept, F.lit(0)))


_MASK = r"\s.\-•∙··・"


def safety_drop_reason(name: Column, emails: Column | None = None, phones: Column | None = None) -> Column:
    """Why a name may not be shown as one; null if it may."""
    n = F.trim(name)
    marks = "(?i)" + "|".join(W.TEST_MARKERS)
    others = [F.exists(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.coalesce(x.rlike(marks), F.lit(False))) for a in (emails, phones) if a is not None]
    return (
        F.when(n.isNull() | (n == ""), "empty_name")
        .when(n.rlike(r"^\+?\d{6,}$"), "phone_as_name")
        .when(n.rlike(f"[{_MASK}]") & n.rlike(rf"^\+?[\d{_MASK}]{{6,}}$"), "unicode_masked_phone")
        .when(n.rlike(".+@.+"), "email_as_name")
        .when(n.rlike("^['\"‘“`].+['\"’”`]$"), "quoted_literal")
        .when(F.lower(n).isin(*W.BOT_NAMES), "bot_name")
        .when(_any([n.rlike(marks), *others]), "test_data_leak")
    )


#: Latin letters with marks and their plain letters, from their Unicode decompositions.
def _plain_letters() -> tuple[str, str]:
    import unicodedata

    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(c, "".join(x for x in d if not unicodedata.combining(x))) for c, d in pairs]
    pairs = [(c, d) for c, d in pairs if len(d) == 1 and d != c and d.isascii()]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def normalize_name(col: Column) -> Column:
    """Marks off Latin letters, lower case, everything but letters and digits to single spaces."""
    plain = F.lower(F.translate(F.regexp_replace(col, r"\p{M}", ""), *_plain_letters()))
    return F.trim(F.regexp_replace(plain, r"[^a-z0-9]+", " "))


def name_tokens(col: Column) -> Column:
    return F.filter(F.split(normalize_name(col), " "), lambda x: x != "")


def is_generic_name(col: Column) -> Column:
    """No token, one that is short, a bare first name, or a vendor."""
    tokens, vendors = name_tokens(col), list(W.VENDOR_DOMAINS)
    first = F.get(tokens, 0)
    one = (F.size(tokens) == 1) & ((F.length(first) < 4) | first.isin(*W.GENERIC_FIRST_NAMES))
    vendor = normalize_name(col).isin(*vendors) | ((F.size(tokens) <= 2) & F.exists(tokens, lambda t: t.isin(*vendors)))
    return F.coalesce((F.size(tokens) < 1) | one | vendor, F.lit(True))


CATEGORIES = ("self", "team", "investor", "sponsor", "fellow", "media", "community", "gov", "founder", "friend", "press", "other")
_ALIASES = {"whatsapp": "other", "whatsapp_contact": "other", "whatsapp-india": "other", "contact": "other", "calendar-meeting": "other", "network": "fellow", "professional": "fellow"}


def normalize_category(col: Column) -> Column:
    low = F.trim(F.lower(col))
    alias = F.create_map(*[F.lit(x) for kv in _ALIASES.items() for x in kv])
    return F.when(low.isin(*CATEGORIES), low).otherwise(F.coalesce(F.element_at(alias, low), F.lit("other")))


def bare_lid(col: Column) -> Column:
    """A device id without suffix and device number; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.trim(col), "(?i)@lid$", ""), r":\d+$", ""), F.lit(""))


def phone_for_contact(contacts: DataFrame, lid_map: DataFrame) -> DataFrame:
    """contacts (jid, phone) and lid_map (lid, pn) -> contacts with ``contact_phone``; a lid only gets the map's phone."""
    joined = contacts.withColumn("__lid", F.when(F.lower("jid").endswith("@lid"), bare_lid(F.col("jid"))))
    joined = joined.join(lid_map.select(F.col("lid").alias("__lid"), F.col("pn").alias("__pn")), "__lid", "left")
    own = F.nullif(F.trim(F.coalesce("phone", F.regexp_replace("jid", r"@s\.whatsapp\.net$", ""))), F.lit(""))
    digits = F.when(F.col("__lid").isNotNull(), F.col("__pn")).when(F.col("jid").endswith("@s.whatsapp.net"), own)
    plus = F.when(digits.startswith("+"), digits).otherwise(F.concat(F.lit("+"), digits))
    return joined.withColumn("contact_phone", plus).drop("__lid", "__pn")


def filter_resolvable(contacts: DataFrame, lid_map: DataFrame) -> DataFrame:
    """Without lid contacts that have neither a name nor a phone in the map."""
    named = F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("full_name", "push_name", "first_name", "business_name") if c in contacts.columns], F.lit(None)).isNotNull()
    return phone_for_contact(contacts, lid_map).where(~F.lower("jid").endswith("@lid") | named | F.col("contact_phone").isNotNull())


def is_business_jid(col: Column) -> Column:
    return F.coalesce(_any([col.rlike(p) for p in W.BUSINESS_JIDS]), F.lit(False))


def is_useless_name(col: Column) -> Column:
    n = F.trim(col)
    return F.coalesce((n == "") | _any([n.rlike(p) for p in W.USELESS_NAMES]), F.lit(True))


def is_spam_text(col: Column) -> Column:
    """Automatic texts.  The patterns see lower-cased text."""
    return F.coalesce(_any([F.lower(col).rlike(p) for p in W.SPAM_TEXTS]), F.lit(False))


def is_newsletter(address: Column, labels: Column | None = None) -> Column:
    low = F.lower(address)
    domain, local = F.when(low.contains("@"), F.substring_index(low, "@", -1)), F.when(low.contains("@"), F.split_part(low, F.lit("@"), F.lit(1)))
    hits = [domain.isin(*W.NEWSLETTER_DOMAINS), local.isin(*W.NEWSLETTER_LOCAL_PARTS), *[domain.endswith("." + d) for d in W.NEWSLETTER_DOMAINS]]
    if labels is not None:
        hits.append(F.array_contains(F.coalesce(labels, F.array().cast("array<string>")), "CATEGORY_PROMOTIONS"))
    return (low.isNull() | (low == "")) | F.coalesce(_any([F.coalesce(h, F.lit(False)) for h in hits]), F.lit(False))


def mail_quality(address: Column, labels: Column, n_cc: Column) -> Column:
    own = F.coalesce(labels, F.array().cast("array<string>"))
    terms = {"CATEGORY_PERSONAL": 0.3, "IMPORTANT": 0.2, "CATEGORY_UPDATES": -0.1, "CATEGORY_PROMOTIONS": -0.4}
    score = F.lit(0.5)
    for label, worth in terms.items():
        score = score + F.when(F.array_contains(own, label), worth).otherwise(0.0)
    score = score + F.when(n_cc > 0, 0.15).otherwise(0.0) + F.when(F.substring_index(address, "@", -1).isin(*W.QUALITY_DOMAINS) & address.contains("@"), 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def is_auto_event(summary: Column, n_attendees: Column) -> Column:
    low = F.lower(F.coalesce(summary, F.lit("")))
    return (F.coalesce(n_attendees, F.lit(0)) == 0) | _any([low.rlike(p) for p in W.AUTO_EVENTS])


def is_real_human(name: Column, is_bot: Column, user_id: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return ~F.coalesce(is_bot, F.lit(False)) & ~F.coalesce(user_id == "USLACKBOT", F.lit(False)) & ~low.isin(*[b for b in W.BOT_NAMES if b != "github-actions"])


def is_junk_label(col: Column) -> Column:
    """Names that a graph does not show: phone-shaped, with ``@``, or of ten digits and more."""
    n = F.trim(col)
    return F.coalesce(n.rlike(r"^\+?[\d\s().-]{6,}$") | n.contains("@") | n.rlike(r"\d{10,}"), F.lit(False))


def slug(col: Column, n: int | None = None) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(col), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.substring(s, 1, n) if n else s
