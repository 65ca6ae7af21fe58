"""Lists and patterns of the rules, in natural order.

They must be these for results to agree with data that was labelled by the same rules.
"""

PERSONAL_DOMAINS = (
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.uk", "yahoo.co.in", "hotmail.com", "hotmail.co.uk", "outlook.com", "live.com",
    "icloud.com", "me.com", "mac.com", "protonmail.com", "proton.me", "pm.me", "duck.com", "fastmail.com", "fastmail.fm", "zoho.com",
    "aol.com", "yandex.com", "yandex.ru", "mail.com", "gmx.com", "gmx.de", "tutanota.com", "tutanota.de", "rediffmail.com",
)
BOT_DOMAINS = (
    "noreply.github.com", "no-reply.com", "notifications.github.com", "notifications.stripe.com", "notifications.slack.com",
    "notifications.linear.app", "alerts.hdfcbank.bank.in", "alerts.icicibank.com",
)
SAAS_DOMAINS = (
    "stripe.com", "slack.com", "notion.so", "notion.com", "linear.app", "github.com", "vercel.com", "supabase.io", "supabase.co", "figma.com",
    "airtable.com", "zoom.us", "meet.google.com", "calendar.google.com", "drive.google.com", "hubspot.com", "salesforce.com", "mailchimp.com",
    "intercom.com", "zendesk.com", "openai.com", "anthropic.com", "cursor.com", "luma.com", "typeform.com", "runwayml.com", "gumroad.com",
)
PRESS_DOMAINS = (
    "nytimes.com", "wsj.com", "ft.com", "bloomberg.com", "techcrunch.com", "theverge.com", "wired.com", "theinformation.com", "axios.com",
    "bbc.com", "reuters.com", "apnews.com",
)
#: Whole local parts of automatic senders.
BOT_LOCAL_PARTS = (
    "noreply", "no-reply", "donotreply", "do-not-reply", "mailer-daemon", "mailer", "notifications?", "notify", "alerts?", "support", "billing",
    "billing-?info", "hello", "help", "security", "updates?", "digest", "newsletter", "info", "team", "account-?info", "accounts?", "receipts?",
    "statements?", "invoices?", "bounces?",
)
#: Tokens that mark an automatic sender anywhere in the local part.
BOT_TOKENS = ("noreply", "no-reply", "donotreply", "do-not-reply", "mailer-daemon", "notifications?", "alerts?", "bounces?", "mailer")
BOT_SUBDOMAINS = ("noreply", "no-reply", "alerts", "notifications", "mail", "bounces", "mailer", "email")
#: Vendor name -> its mail domains.
VENDOR_DOMAINS = {
    "digitalocean": ["digitalocean.com"],
    "digital ocean": ["digitalocean.com"],
    "stripe": ["stripe.com"],
    "aws": ["amazon.com", "aws.amazon.com"],
    "amazon": ["amazon.com", "amazon.in", "amazon.co.uk"],
    "amazon web services": ["amazon.com", "aws.amazon.com"],
    "notion": ["notion.so", "notion.com", "makenotion.com"],
    "linear": ["linear.app"],
    "gumroad": ["gumroad.com"],
    "booking.com": ["booking.com"],
    "airbnb": ["airbnb.com"],
    "cloudflare": ["cloudflare.com"],
    "microsoft": ["microsoft.com", "outlook.com", "live.com"],
    "google": ["google.com", "gmail.com"],
    "meta": ["meta.com", "facebook.com", "fb.com"],
    "openai": ["openai.com"],
    "anthropic": ["anthropic.com"],
    "github": ["github.com"],
    "gitlab": ["gitlab.com"],
    "vercel": ["vercel.com"],
    "supabase": ["supabase.io", "supabase.co", "supabase.com"],
    "figma": ["figma.com"],
    "slack": ["slack.com"],
    "zoom": ["zoom.us"],
    "hubspot": ["hubspot.com"],
    "salesforce": ["salesforce.com"],
    "mailchimp": ["mailchimp.com"],
    "intercom": ["intercom.com"],
    "zendesk": ["zendesk.com"],
    "shopify": ["shopify.com"],
    "calendly": ["calendly.com"],
    "docusign": ["docusign.com"],
    "dropbox": ["dropbox.com"],
    "atlassian": ["atlassian.com", "atlassian.net"],
    "jira": ["atlassian.com", "atlassian.net"],
    "confluence": ["atlassian.com", "atlassian.net"],
    "asana": ["asana.com"],
    "trello": ["trello.com"],
    "quickbooks": ["intuit.com", "quickbooks.com"],
    "xero": ["xero.com"],
    "razorpay": ["razorpay.com"],
    "paypal": ["paypal.com"],
    "apple": ["apple.com", "icloud.com", "me.com", "mac.com"],
}
GENERIC_FIRST_NAMES = (
    "john", "mike", "dave", "bob", "ram", "raj", "tom", "sam", "alex", "chris", "pat", "max", "jay", "ken", "lee", "amy", "ann", "kim", "meg",
    "joe", "sue", "don", "ben", "dan", "ed", "al", "jim", "ron", "tim",
)
BOT_NAMES = ("wazowski", "chad", "axe", "kite", "slackbot", "github-actions")
TEST_MARKERS = (r"example\.com", r"example\.org", r"@test\.com", r"\bapitest\.")
NEWSLETTER_DOMAINS = (
    "nvidia.com", "google.com", "grafana.com", "substack.com", "medium.com", "linkedin.com", "twitter.com", "facebook.com", "instagram.com",
    "coursera.org", "maven.com", "udemy.com", "economictimesnews.com", "etprime.com", "getonecard.app", "hdfcbank.bank.in", "netflix.com",
    "amazon.in", "amazon.com", "flipkart.com", "zomato.com", "swiggy.com", "paytm.com", "phonepe.com", "googlepay.com", "members.netflix.com",
    "mailers.hdfcbank.bank.in", "notifications.google.com",
)
NEWSLETTER_LOCAL_PARTS = (
    "noreply", "no-reply", "donotreply", "newsletter", "notifications", "mailer-daemon", "postmaster", "support", "info", "hello", "team",
    "marketing", "sales", "billing", "updates", "digest", "news", "alerts", "notify", "account-info", "service", "promo",
)
QUALITY_DOMAINS = ("gmail.com", "outlook.com", "yahoo.com", "hotmail.com", "icloud.com", "protonmail.com")
BUSINESS_JIDS = (r"^91\d{5}00\d{3}@", r"@broadcast$", r"^status@")
USELESS_NAMES = (r"^[\d\s+\-()]+$", r"^[^\p{L}\p{N}_]+$", r"^.{1,2}$")
SPAM_TEXTS = (r"otp\s+is\s+\d{4,6}", r"your\s+loan\s+(amount|is)\s+", r"insta\s+cash\s+amount", r"credit\s+card\s+statement", r"your\s+order\s+#", r"track\s+your\s+(shipment|order|delivery)")
AUTO_EVENTS = (
    r"flight\s+to\b", r"hotel\b", r"check.?in\b", r"check.?out\b", r"pickup\b", r"drop.?off\b", r"reminder\b", r"birthday\b", r"anniversary\b",
    r"bill\s+due\b", r"renewal\b", r"subscription\b",
)
COMMERCIAL_WORDS = (
    "sale", "sales", "deal", "deals", "offer", "offers", "crypto", "giveaway", "giveaways", "coupon", "coupons", "promo", "promos", "discount",
    "discounts", "airdrop", "airdrops", "signup bonus", "referral", "referrals",
)
