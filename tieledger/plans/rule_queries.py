"""Rule functions over handles and names made from the given tables, and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieledger.functions import normalize as N
from tieledger.functions import scoring as S
from tieledger.functions import words as W
from tieledger.plans.registry import Registry

Q = Registry()


def _list(values) -> str:
    return ", ".join(f"'{x}'" for x in values)


@Q.add("normalized_phones", """
SELECT c_custkey, CASE k WHEN 0 THEN '+91' || d WHEN 1 THEN '+919' || d WHEN 2 THEN '+' || '9' || d WHEN 3 THEN NULL ELSE NULL END AS phone FROM (SELECT c_custkey, c_custkey % 5 AS k, cast(7000000000 + c_custkey AS varchar) AS d FROM {customer})""")
def _(v):
    d, k = (F.col("c_custkey") + 7000000000).cast("string"), F.col("c_custkey") % 5
    raw = F.when(k == 0, F.concat_ws(" ", F.substring(d, 1, 5), F.substring(d, 6, 5))).when(k == 1, F.concat(F.lit("919"), d, F.lit("@s.whatsapp.net")).substr(F.lit(1), F.lit(40)))
    raw = raw.when(k == 2, F.concat(F.lit("+9-"), d)).when(k == 3, F.substring(d, 1, 6)).otherwise(F.lit(" "))
    return v("customer").select("c_custkey", N.normalize_phone(raw).alias("phone"))


@Q.add("address_book_phones", """
SELECT c_custkey, CASE k WHEN 0 THEN '+1' || d WHEN 1 THEN '+1' || d WHEN 2 THEN '+44' || d END AS phone FROM (SELECT c_custkey, c_custkey % 4 AS k, cast(7000000000 + c_custkey AS varchar) AS d FROM {customer})""")
def _(v):
    d, k = (F.col("c_custkey") + 7000000000).cast("string"), F.col("c_custkey") % 4
    raw = F.when(k == 0, d).when(k == 1, F.concat(F.lit("1-"), d)).when(k == 2, F.concat(F.lit("+44 "), d)).otherwise(F.substring(d, 1, 7))
    return v("customer").select("c_custkey", N.canon_phone_nanp(raw).alias("phone"))


_DOMAINS = ["gmail.com", "googlemail.com", "acme.test", "stripe.com", "ft.com", "local.news", "mail.acme.test", "noreply.github.com", "bad..test", "nodot"]
_LOCALS = ["First.Last", "billing", "a.noreply", "jo+tag", "team-alerts", "+x"]


def _mails(v):
    k = F.col("c_custkey")
    domain = F.element_at(F.array(*map(F.lit, _DOMAINS)), (k % 10 + 1).cast("int"))
    local = F.element_at(F.array(*map(F.lit, _LOCALS)), (k % 6 + 1).cast("int"))
    return v("customer").select("c_custkey", domain.alias("domain"), local.alias("local"), F.concat(F.lit(" "), local, F.lit("@"), F.upper(domain)).alias("email"))


_MAIL_SQL = f"(SELECT c_custkey, [{_list(_DOMAINS)}][c_custkey % 10 + 1] AS domain, [{_list(_LOCALS)}][c_custkey % 6 + 1] AS local FROM {{customer}})"
_VALID = "regexp_matches(domain, '^[a-z0-9][a-z0-9.-]*\\.[a-z]{2,}$') AND l <> ''"


@Q.add("canonical_emails", f"""
SELECT c_custkey, CASE WHEN {_VALID} THEN CASE WHEN domain IN ('gmail.com', 'googlemail.com') THEN replace(l, '.', '') || '@gmail.com' ELSE l || '@' || domain END END AS canonical, {_VALID} AS valid
FROM (SELECT c_custkey, domain, regexp_replace(lower(local), '\\+.*$', '') AS l FROM {_MAIL_SQL})""")
def _(v):
    return _mails(v).select("c_custkey", N.canonicalize_email(F.col("email")).alias("e")).select("c_custkey", "e.canonical", "e.valid")


_TOK = "|".join(W.BOT_TOKENS)
_LOC = "|".join(W.BOT_LOCAL_PARTS)


@Q.add("domain_classes", f"""
SELECT c_custkey, CASE WHEN regexp_matches(lower(local), '^({_LOC})$') OR regexp_matches(lower(local), '(^|[-_.])({_TOK})([-_.]|$)') THEN 'bot' WHEN domain IN ({_list(W.BOT_DOMAINS)}) OR regexp_matches(domain, '^({"|".join(W.BOT_SUBDOMAINS)})\\.') THEN 'bot'
 WHEN domain IN ({_list(W.PERSONAL_DOMAINS)}) THEN 'personal' WHEN domain IN ({_list(W.SAAS_DOMAINS)}) THEN 'saas' WHEN domain IN ({_list(W.PRESS_DOMAINS)}) OR domain LIKE '%.press' OR domain LIKE '%.news' THEN 'press'
 WHEN regexp_matches(domain, '^[a-z0-9][a-z0-9.-]*\\.[a-z]{{2,}}$') AND domain NOT LIKE '%..%' THEN 'work' ELSE 'other' END AS class FROM {_MAIL_SQL}""".replace("{{2,}}", "{2,}"))
def _(v):
    return _mails(v).select("c_custkey", N.domain_class(F.col("domain"), F.col("local"))["class"].alias("class"))


@Q.add("newsletter_mails", f"""
SELECT c_custkey, domain IN ({_list(W.NEWSLETTER_DOMAINS)}) OR lower(local) IN ({_list(W.NEWSLETTER_LOCAL_PARTS)}) OR c_custkey % 13 = 0 AS newsletter,
 round(least(1.0, greatest(0.0, 0.5 + CASE WHEN c_custkey % 13 = 0 THEN -0.4 ELSE 0.3 END + CASE WHEN c_custkey % 2 = 0 THEN 0.15 ELSE 0 END + CASE WHEN domain = 'gmail.com' THEN 0.1 ELSE 0 END)), 6) AS quality FROM {_MAIL_SQL}""")
def _(v):
    address = F.concat("local", F.lit("@"), "domain")
    labels = F.when(F.col("c_custkey") % 13 == 0, F.array(F.lit("CATEGORY_PROMOTIONS"))).otherwise(F.array(F.lit("CATEGORY_PERSONAL")))
    return _mails(v).select("c_custkey", N.is_newsletter(address, labels).alias("newsletter"), F.round(N.mail_quality(address, labels, 1 - F.col("c_custkey") % 2), 6).alias("quality"))


_NAMES = ["", "+91987654321", "98 76•54 321", "a@b", "\"Quoted\"", "Slackbot", "x example.com", "José Núñez", "Al", "Stripe", "Amazon Pay", "Mary Ann Lee"]
_REASONS = ["empty_name", "phone_as_name", "unicode_masked_phone", "email_as_name", "quoted_literal", "bot_name", "test_data_leak"]


def _named(v):
    return v("supplier").select("s_suppkey", F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("s_suppkey") % 12 + 1).cast("int")).alias("name"))


@Q.add("name_safety", f"SELECT s_suppkey, [{_list(_REASONS)}][s_suppkey % 12 + 1] AS reason, s_suppkey % 12 NOT IN (1, 2, 3, 4, 5, 6, 7, 11) AS generic, [NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'jose nunez', 'al', 'stripe', 'amazon pay', 'mary ann lee'][s_suppkey % 12 + 1] AS plain FROM {{supplier}}")
def _(v):
    plain = F.when(F.col("s_suppkey") % 12 >= 7, N.normalize_name(F.col("name")))
    return _named(v).select("s_suppkey", N.safety_drop_reason(F.col("name")).alias("reason"), N.is_generic_name(F.col("name")).alias("generic"), plain.alias("plain"))


@Q.add("category_normalization", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'fellow' WHEN 1 THEN 'team' WHEN 2 THEN 'fellow' ELSE 'other' END AS category FROM {customer}")
def _(v):
    raw = F.element_at(F.array(*map(F.lit, (" Network ", "TEAM", "professional", "whatsapp", "unknown"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return v("customer").select("c_custkey", N.normalize_category(raw).alias("category"))


@Q.add("bare_lids", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE cast(c_custkey AS varchar) END AS lid FROM {customer}")
def _(v):
    k = F.col("c_custkey").cast("string")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(k, F.lit(":12@LID"))).when(F.col("c_custkey") % 3 == 1, F.concat(k, F.lit("@lid"))).otherwise(F.lit("@lid"))
    return v("customer").select("c_custkey", N.bare_lid(raw).alias("lid"))


@Q.add("contact_phones", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey IN (SELECT user_id FROM {events} WHERE user_id % 7 <> 0) THEN '+' || cast(919000000000 + c_custkey AS varchar) END ELSE '+' || cast(55500000 + c_custkey AS varchar) END AS phone FROM {customer}")
def _(v):
    k = F.col("c_custkey")
    jid = F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit("@lid"))).otherwise(F.concat((k + 55500000).cast("string"), F.lit("@s.whatsapp.net")))
    contacts = v("customer").select("c_custkey", jid.alias("jid"), F.lit(None).cast("string").alias("phone"))
    return N.phone_for_contact(contacts, v("bridge").select("lid", F.col("phone").alias("pn"))).select("c_custkey", F.col("contact_phone").alias("phone"))


@Q.add("address_lists", "SELECT s_suppkey, n, name, email FROM (SELECT s_suppkey, 1 AS n, s_name AS name, 'a' || cast(s_suppkey AS varchar) || '@acme.test' AS email FROM {supplier} UNION ALL SELECT s_suppkey, 2, 'Doe, Jane', 'jane@acme.test' FROM {supplier} UNION ALL SELECT s_suppkey, 3, NULL, 'bare@acme.test' FROM {supplier})")
def _(v):
    header = F.concat("s_name", F.lit(" <a"), F.col("s_suppkey").cast("string"), F.lit('@acme.test>, "Doe, Jane" <jane@acme.test>, bare@acme.test, none'))
    rows = v("supplier").select("s_suppkey", F.posexplode(N.parse_addresses(header)).alias("n", "x"))
    return rows.select("s_suppkey", (F.col("n") + 1).alias("n"), "x.name", "x.email")


@Q.add("forwarded_names", "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN s_name WHEN 1 THEN s_name WHEN 2 THEN NULL WHEN 3 THEN 'Stripe' ELSE s_name || ' (Home)' END AS name FROM {supplier}")
def _(v):
    k, n = F.col("s_suppkey") % 5, F.col("s_name")
    name = F.when(k == 0, F.concat(n, F.lit(" via Google Docs"))).when(k == 1, F.concat(n, F.lit(" (Slack)"))).when(k == 2, "Stripe").when(k == 3, "Stripe").otherwise(F.concat(n, F.lit(" (Home)")))
    email = F.when(k == 3, "x@mail.stripe.com").otherwise("x@acme.test")
    return v("supplier").select("s_suppkey", N.strip_forwarded_name(name, email).alias("name"))


@Q.add("junk_labels", "SELECT s_suppkey, s_suppkey % 3 <> 2 AS junk FROM {supplier}")
def _(v):
    name = F.when(F.col("s_suppkey") % 3 == 0, "+1 (555) 010-2030").when(F.col("s_suppkey") % 3 == 1, "me@acme.test").otherwise(F.substring("s_name", 1, 8))
    return v("supplier").select("s_suppkey", N.is_junk_label(name).alias("junk"))


def _case(values: dict, key: str, default) -> str:
    q = lambda x: f"'{x}'" if isinstance(x, str) else x
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {q(x)}" for k, x in values.items()) + f" ELSE {q(default)} END"


_CHANNEL = "['meeting', 'whatsapp_dm', 'whatsapp', 'email', 'slack', 'linear', 'fax', 'email_personal'][event_id % 8 + 1]"
_SIGNAL = _case(S.CHANNELS, _CHANNEL, "email_cc")


@Q.add("signal_scores", f"""
SELECT event_id, kind, round(least({_case(S.SIGNALS, 'kind', 0.5)} * {_case(S.BOOSTS, 'channel', 1.0)} * exp(-days / 90.0) * CASE WHEN event_id % 3 = 0 THEN 1.2 ELSE 1.0 END, 2.0), 3) AS score
FROM (SELECT event_id, {_CHANNEL} AS channel, {_SIGNAL} AS kind, cast(event_id % 200 AS double) AS days FROM {{events}})""")
def _(v):
    channel = F.element_at(F.array(*map(F.lit, ("meeting", "whatsapp_dm", "whatsapp", "email", "slack", "linear", "fax", "email_personal"))), (F.col("event_id") % 8 + 1).cast("int"))
    kind = S.channel_to_signal(channel)
    return v("events").select("event_id", kind.alias("kind"), S.signal_score(kind, channel, (F.col("event_id") % 200).cast("double"), F.col("event_id") % 3 == 0).alias("score"))


@Q.add("score_functions", """
SELECT event_id, CASE WHEN value / 10 <= 1 OR d <= 7 THEN round(value / 10, 6) ELSE round(greatest(value / 10 * pow(0.98, d - 7), 0.5), 2) END AS decayed, CASE WHEN value - 5 <= 0 THEN 0 ELSE round(least(ln(1 + value - 5) / ln(21) * 10, 10), 2) END AS normal,
 round(least(least(d * 0.15, 0.7) + CASE WHEN event_id % 2 = 0 THEN 0.2 ELSE 0 END, 1.0), 6) AS knows, CASE WHEN d <= 2 THEN 'calendar_small' ELSE 'calendar_large' END AS meeting,
 round(CASE WHEN event_id % 5 = 0 THEN 0 ELSE CASE event_type WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.3 ELSE 1.0 END + least(d * 0.2, 1.0) END, 6) AS issue FROM (SELECT *, event_id % 30 AS d FROM {events})""")
def _(v):
    d = (F.col("event_id") % 30).cast("double")
    state = F.when(F.col("event_type") == "click", "Done").when(F.col("event_type") == "view", "Backlog").otherwise("active")
    who = F.when(F.col("event_id") % 5 != 0, "somebody")
    return v("events").select(
        "event_id", F.round(S.decay(F.col("value") / 10, d), 6).alias("decayed"), S.normalize_score(F.col("value") - 5).alias("normal"), F.round(S.knows_strength(d, F.col("event_id") % 2 == 0), 6).alias("knows"),
        S.meeting_signal(d).alias("meeting"), F.round(S.issue_weight(state, who, d), 6).alias("issue"),
    )


@Q.add("person_scores", f"""
SELECT user_id, person_id, CASE WHEN raw <= 0 THEN 0 ELSE round(least(ln(1 + raw) / ln(21) * 10, 10), 2) END AS score FROM (
 SELECT 't' AS user_id, user_id AS person_id, sum(round(least({_case(S.SIGNALS, 'kind', 0.5)} * {_case(S.BOOSTS, 'channel', 1.0)} * exp(-greatest(0, (epoch_us(TIMESTAMP '2024-02-20 00:00:00') - epoch_us(ts)) / 86400000000.0) / 90.0), 2.0), 3)) + 0.15 AS raw
 FROM (SELECT user_id, ts, CASE event_type WHEN 'click' THEN 'whatsapp_dm' ELSE 'email' END AS channel, CASE event_type WHEN 'click' THEN 'whatsapp_dm' ELSE 'email_cc' END AS kind FROM {{events}}) GROUP BY user_id)""")
def _(v):
    e = v("events").select(F.lit("t").alias("user_id"), F.col("user_id").alias("person_id"), F.when(F.col("event_type") == "click", "whatsapp_dm").otherwise("email").alias("channel"), F.col("ts").alias("occurred_at"), F.lit(False).alias("reciprocal"))
    knows = e.select("user_id", "person_id").distinct().withColumn("strength", S.knows_strength(F.lit(1.0), F.lit(False)))
    return S.score_persons(e, knows, "2024-02-20 00:00:00").select("user_id", "person_id", "score")


