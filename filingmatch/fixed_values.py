"""The word lists, lookup tables, constants, patterns and formats that decide results.

Everything in this module is a FIXED VALUE. Changing an entry changes what the engine answers, so the values are kept
together, as plain text and in their natural order; the logic that uses them lives elsewhere.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------- fixed values: words of names

NOT_NAME = """
our team about contact us home services solutions company leadership meet the who we are what do
founder cofounder co-founder ceo cto coo cfo cio cmo vp svp evp president owner chief executive officer technology operating product
managing director partner principal member read more learn view all get started book call privacy policy terms
cookie careers blog news inc llc corp ltd and or of for in at to a an with by from join now sign login log menu
search follow customer customers testimonial testimonials review reviews client clients
""".split()

ORGWORDS = """
aerospace farms farm digital studio studios labs lab systems group software solutions consulting services
company holdings technologies tech university hospital bank church school health medical dental law
""".split()

BIZ_WORDS = """
pipeline summary team teams leads lead careers career support studio studios labs lab inc llc llp lp ltd plc corp
corporation incorporated company companies co solutions solution services service systems system software technologies technology
tech consulting consultants partners associates group holdings holding enterprises ventures capital media digital agency network
networks platform platforms programs program national international global foundation institute association board council
committee department division center centre offices products product resources security analytics cloud data questionnaire explore
note notes dashboard overview welcome profile profiles staff employees jobs openings positions hiring press news blog events
webinar privacy policy conditions copyright rights reserved newsletter subscribe signup register potential today tomorrow
""".split()

PLACEHOLDER_WORDS = """
doe lorem ipsum dolor amet consectetur name firstname lastname surname forename placeholder sample test tester
user foo tbd tba anonymous unknown admin administrator public first last full your yourname here insert example
""".split()

UI_WORDS = """
click tap swipe scroll links link responsibility studies papers base map questions question posts articles article
projects project values hours locations location message messages connected connect demo trial account accounts consultation quote
quotes estimates estimate pricing brochure video videos form back chat status order track tracking report reports results stories
practices insights owned insured cards credits next previous prev free help desk office main head regional daily annual weekly
monthly quarterly yearly appointment sunday sundays today now request subscribe try ask find send write visit submit apply accept
decline load open discover watch play download buy shop start how why when where works it its this that these those there you my
me is are say hello reach out talk go sale deals deal update updates offer offers special specials discount discounts coupon promo
copyright notice proudly serving since as on seen trusted powered designed made built award winning happy touch phone fax number
toll mobile tel telephone email emails
""".split()

TRADE_WORDS = """
design development apps intelligence learning machine managed hosting repair care control grooming photography
plumbing plumbers roofing roofers electric electrical electricians landscaping cleaning painting construction contractor contractors
builders remodeling flooring heating cooling insurance mortgage realty realtors attorneys lawyers accounting bookkeeping dentistry
orthodontics chiropractic salon fitness pizza bakery restaurant cafe grill catering florist jewelers pharmacy clinic veterinary
motors towing moving printing graphics productions entertainment academy ministries brewery roasters estate marketing web cyber
domain domains social optimization custom virtual remote voice conferencing disaster recovery backup migration integration testing
audit assessment automation computing blockchain internet transformation architecture technical hardware payroll tax preparation
inspection roof pest dental pet auto yoga food truck strategy brand quality assurance management engineering database supply chain
risk compliance works industries manufacturing supplies equipment machinery tools brothers bros sons sisters widgets widget acme
penetration reliability
""".split()

ROLE_WORDS = """
manager managers administrator analyst scientist architect technician specialist coordinator assistant ambassador
operator engineer developer consultant senior junior vice general front dev ops devops business property better bureau microsoft
google amazon oracle cisco salesforce comptia facebook linkedin twitter instagram youtube yelp trustpilot accredited certified
certification platinum channel gallery feed customer
""".split()

BRAND_WORDS = """
prime bold pure rapid clear quantum pixel byte future vision move genius growth time leap perfect ninja lining
notch horizon point licensed bonded action items
""".split()

SCENERY = """
blue red green white black gold golden silver gray grey brown orange purple pink north south east west northern southern
eastern western iron steel copper stone rock rocks ridge hill hills grove bend view breeze peak peaks mountain mountains valley lake
creek springs harbor harbour bay island pine cedar maple oak elm birch eagle falcon hawk phoenix tiger lion dragon sun moon star stars
sky ocean sea summit lone big top true gate horizon alpha omega delta sigma gamma beta apex zenith vertex force predator rising
""".split()

STATES = """
alabama alaska arizona arkansas california colorado connecticut delaware florida georgia hawaii idaho illinois indiana iowa
kansas kentucky louisiana maine maryland massachusetts michigan minnesota mississippi missouri montana nebraska nevada ohio oklahoma
oregon pennsylvania tennessee texas utah vermont virginia wisconsin wyoming
""".split()

CITIES = """
austin houston dallas phoenix portland seattle denver boston chicago atlanta miami orlando tampa detroit memphis nashville
charlotte sacramento oakland plano irving philadelphia pittsburgh cleveland columbus cincinnati milwaukee minneapolis baltimore richmond
raleigh tucson fresno omaha tulsa wichita lexington louisville buffalo rochester albany hartford stamford bridgeport
""".split()

PHRASES = [p.strip() for p in """
new york|new jersey|new mexico|new hampshire|north carolina|south carolina|north dakota|south dakota|west virginia|rhode island|
los angeles|san francisco|san diego|san jose|san antonio|las vegas|new orleans|kansas city|salt lake city|oklahoma city|fort worth|el paso|
long beach|virginia beach|st louis|saint louis|st paul|santa ana|santa fe|santa clara|palo alto|silicon valley|bay area|wall street|gulf coast|
west coast|east coast|new england|great lakes|united states|united kingdom|north america|south america|middle east|hong kong|new delhi|
buenos aires|mexico city|tel aviv|abu dhabi|sao paulo|rio de janeiro|cape town|kuala lumpur|new zealand|south africa|district of columbia|
jane doe|john doe|jane q public|john q public|mickey mouse|minnie mouse|donald duck|santa claus|foo bar|first last|name surname|
test user|mary sue|joe bloggs|joe blow|john public|jane public|average joe
""".replace("\n", "").split("|")]
PLACE_WORDS = ["coast", "states", "valley"]
PARTICLES = ("van von der den de del della di da dos du la le bin bint al el ben ibn ten ter los las y e").split()
HONORIFICS = ["dr", "mr", "ms", "mrs", "prof", "engr"]
NAME_SUFFIX = ["jr", "sr", "ii", "iii", "iv"]
SURNAMEABLE = ("jobs press cloud board center centre home service register staff welcome note read more book sales news "
               "capital").split()
LAST_OK = ["do", "co", "to"]
STREET_WORDS = ("street avenue road lane drive boulevard highway parkway court place circle terrace trail path square plaza "
                "alley way").split()
LABEL_WORDS = ("plan option type phase section class level step grade size version part item tier zone unit room floor suite "
               "vitamin team group chapter figure table exhibit").split()
NAME_MAX = 60
NAME_TOKENS_MAX = 7

# The list of common given names is a parameter (`Lexicon.given_names`); this is only its default.
DEFAULT_GIVEN_NAMES = """
aaron adam alan albert alexander alice amanda amy andrea andrew angela ann anna anthony arthur ashley austin barbara benjamin
betty brandon brenda brian bruce carl carol carolyn catherine charles cheryl christine christopher cynthia daniel david deborah
debra denise dennis diana diane donald donna dorothy douglas edward elizabeth emily emma eric evelyn frances frank gary george
gerald gloria grace gregory hannah harold heather helen henry jack jacob jacqueline james janet janice jason jean jeffrey jennifer
jerry jesse jessica joan joe john jonathan jose joseph joshua joyce juan judith judy julia julie justin karen katherine kathleen
keith kelly kenneth kevin kimberly kyle larry laura lauren lawrence linda lisa louis margaret maria marie marilyn mark martha mary
matthew megan melissa michael michelle nancy nathan nicholas nicole olivia pamela patricia patrick paul peter philip rachel ralph
raymond rebecca richard robert roger ronald rose roy russell ruth ryan samantha samuel sandra sara sarah scott sean sharon shirley
sophia stephanie stephen steve steven susan teresa theresa thomas timothy tyler victoria vincent virginia walter wayne william
""".split()

# ------------------------------------------------------------------------------------------ fixed values: names of companies
LEGAL_SUFFIX = ("llc inc incorporated corp corporation co company ltd limited llp lp pllc pc plc the dba lc pa liability").split()
FOREIGN_SUFFIX = "oy oyj ab as asa gmbh ag bv nv sa sas sarl srl spa pty pvt kk ltda aps kft sro".split()
GENERIC = ("tech technologies technology software systems system solutions solution consulting services service group labs lab "
           "studio studios digital global international holdings holding enterprises partners ventures it data cloud ai media "
           "networks network").split()
UPPER_TOKENS = ("LLC INC LLP LP AI IT USA US PLLC LC II III IV MSP HVAC CPA DBA PC PA NW NE SW SE N S E W").split()
COMPANY_SUFFIX = (r"(?i)\b(llc|l\.l\.c|inc|incorporated|corp|corporation|co|company|ltd|limited|llp|lp|pllc|pc|plc|holdings|group|"
                  r"partners|associates|labs|studio|studios|technologies|systems)\b\.?")
TLDS = ["com", "io", "ai", "co", "app", "dev", "net", "org", "us", "tech", "cloud", "llc", "agency"]

# ---------------------------------------------------------------------------------------------- fixed values: industry codes
IT_PREFIXES = ["5112", "5132", "5162", "5182", "5191", "5192", "5415", "517"]
TX_ORG = {"CL": "LLC / Corp", "CF": "Foreign corp", "CT": "Trust", "CI": "Partnership", "IS": "Sole proprietor", "PL": "Partnership"}

# ------------------------------------------------------------------------------------------------- fixed values: mail domains
AGENT_DOMAINS = """
registeredagentsinc.com northwestregisteredagent.com incauthority.com zenbusiness.com legalzoom.com harborcompliance.com
bizfilings.com corpnet.com cscglobal.com cscinfo.com vcorpservices.com ctcorporation.com swyftfilings.com tailorbrands.com
mycorporation.com bizee.com incfile.com legalinc.com cogencyglobal.com paracorp.com wolterskluwer.com rocketlawyer.com
registeredagent.com nationalregisteredagents.com incorporate.com doola.com corporationservicecompany.com
northwestregisteredagent.net registered-agent-solutions.com
""".split()
AGENT_FRAGMENTS = ["registeredagent", "registered-agent"]
FREE_MAIL = """
gmail.com yahoo.com outlook.com hotmail.com icloud.com aol.com proton.me protonmail.com pm.me live.com msn.com me.com comcast.net
sbcglobal.net att.net mail.com gmx.com yandex.com qq.com 163.com 126.com ymail.com googlegroups.com
""".split()
PUBLIC_SUFFIX_2 = """
co.uk org.uk ac.uk gov.uk me.uk ltd.uk plc.uk com.au net.au org.au co.nz org.nz co.in net.in org.in co.za org.za com.br com.mx
com.ar com.co co.jp or.jp ne.jp com.sg com.hk com.cn com.tw co.kr co.il com.tr com.pk com.ph com.my com.ng co.ke com.eg com.sa
com.ua co.id com.vn com.bd
""".split()
EMAIL = r"[a-zA-Z0-9._%+\-]{1,64}@[a-zA-Z0-9\-]{1,63}(?:\.[a-zA-Z0-9\-]{1,63})*\.[a-zA-Z]{2,24}"
EMAIL_STRICT = r"^[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63})*\.[A-Za-z]{2,24}$"
EMAIL_MAX = 254
BAD_EMAIL = (r"(?i)\.(png|jpe?g|gif|svg|webp|css|js|woff2?|ico)$|sentry|wixpress|example\.|yourdomain|domain\.com|email\.com|"
             r"youremail|your@|name@|user@|test@|@2x|noreply|no-reply|donotreply|u003|@mysite\.|@company\.|@sample|"
             r"appleseed|@mac\.com$|godaddy|privacy@|abuse@|you@|@sentry|@yourcompany|@website\.com|@site\.com")
# the front-door mailboxes, best first, and the mailboxes that belong to a function
FRONT_DOOR = ["hello", "info", "contact", "sales", "hi", "team", "office", "inquiries", "mail", "admin", "support"]
FUNCTION_MAILBOX = (
    r"(?i)^(privacy|legal|dmca|copyright|abuse|press|media|pr|careers?|jobs?|hr|recruit\w*|billing|accounts?|invoices?|payables?|"
    r"noreply|no-reply|donotreply|webmaster|postmaster|security|compliance|contracts?|procurement|unsubscribe|bounce|mailer-daemon|"
    r"investors?|ir|gdpr|ccpa|concerns?|complaints?|fraud|scam|phishing|spam|reports?|whistleblower|ethics|dpo|"
    r"data[._-]?protection|(?:corporate|legal|service)[._-]?notices?|notices?|registered[._-]?agents?|service[._-]?of[._-]?process|"
    r"remove[._-]?me|remove|opt[._-]?out|delete[._-]?me|takedown)$")
FUNCTION_MAILBOX_WORDS = ("hr careers recruiting recruitment billing invoices payables unsubscribe abuse privacy legal dmca gdpr dpo "
                          "noreply remove optout relations press media jobs").split()

# ------------------------------------------------------------------------------------------------------- fixed values: phones
NON_GEOGRAPHIC_AREAS = "500 521 522 523 524 525 526 527 528 529 533 544 566 577 588 600 622 700 710 900".split()
PHONE_BODY = r"(?:\+?1[\s.\-]?)?\(?([2-9]\d{2})\)?[\s.\-]?([2-9]\d{2})[\s.\-]?(\d{4})"
OTHER_PEOPLES_PHONE = (r"media contact|press contact|public relations|press inquir|media inquir|for press|for media|investor relations|"
                       r"arbitrat|adr\.org|dispute|complain|better business|\bbbb\b|dmca|copyright agent|regulator|attorney general|"
                       r"ombuds")
TEL_EXTENSION = r"(?i)[;,#]|ext|x|(?<=\d)[pw](?=\d)"

# ------------------------------------------------------------------------------------------------------- fixed values: places
# (state, first ZIP, last ZIP): the first range that holds a ZIP wins
ZIP_RANGES = [
    ("AL", 35000, 36999), ("AK", 99500, 99999), ("AZ", 85000, 86999), ("AR", 71600, 72999), ("CA", 90000, 96199),
    ("CO", 80000, 81999), ("CT", 6000, 6999), ("DE", 19700, 19999), ("DC", 20000, 20599), ("FL", 32000, 34999),
    ("GA", 30000, 31999), ("GA", 39800, 39999), ("HI", 96700, 96899), ("ID", 83200, 83999), ("IL", 60000, 62999),
    ("IN", 46000, 47999), ("IA", 50000, 52999), ("KS", 66000, 67999), ("KY", 40000, 42799), ("LA", 70000, 71599),
    ("ME", 3900, 4999), ("MD", 20600, 21999), ("MA", 1000, 2799), ("MA", 5500, 5599), ("MI", 48000, 49999),
    ("MN", 55000, 56799), ("MS", 38600, 39799), ("MO", 63000, 65899), ("MT", 59000, 59999), ("NE", 68000, 69399),
    ("NV", 88900, 89999), ("NH", 3000, 3899), ("NJ", 7000, 8999), ("NM", 87000, 88499), ("NY", 10000, 14999),
    ("NC", 27000, 28999), ("ND", 58000, 58899), ("OH", 43000, 45999), ("OK", 73000, 74999), ("OR", 97000, 97999),
    ("PA", 15000, 19699), ("RI", 2800, 2999), ("SC", 29000, 29999), ("SD", 57000, 57799), ("TN", 37000, 38599),
    ("TX", 75000, 79999), ("TX", 88500, 88599), ("UT", 84000, 84999), ("VT", 5000, 5499), ("VT", 5600, 5999),
    ("VA", 20100, 20199), ("VA", 22000, 24699), ("WA", 98000, 99499), ("WV", 24700, 26999), ("WI", 53000, 54999),
    ("WY", 82000, 83199),
]
STREET_DIRECTIONS = ("n s e w ne nw se sw north south east west northeast northwest southeast southwest").split()

# ------------------------------------------------------------------------------------------------- fixed values: people titles
TITLE_WORDS = (r"(?:co-?\s?founder|founder|chief executive officer|ceo|president|owner|chief technology officer|cto|"
               r"chief operating officer|coo|chief product officer|cpo|managing director|managing partner|principal|"
               r"managing member|chief executive|executive director)")
LEAD_TITLE = r"(?i)\b" + TITLE_WORDS + r"\b"
TITLE_MAX = 60
TITLE_CHARS = r"^[A-Za-z0-9 &,.'’\-–—/()+;·|•]+$"
TITLE_FRONT = r"(?i)^(?:meet|about|our|the|your|a|an)\s+"
TITLE_TAIL = r"(?i)(?:\s+(?:and|of|at|for|the|to|in|with|&)|[\s,;/\-–—|•·&]+)$"
TITLE_SPLIT = r"\s*[·|•;]\s*|\s+[\-–—]\s+"
TITLE_ABBREV = ("CEO COO CTO CFO CIO CMO CPO CRO CISO CDO CCO CSO CAO CHRO VP SVP EVP MD HR IT AI QA UX UI MBA CPA LLC INC SEO AWS SAP "
                "ERP CRM PMO NOC PMP CISSP DBA").split()
TITLE_SMALL = "AND OF AT FOR THE TO IN WITH OR AN ON BY".split()
FOUNDED_BY = (r"(?:founded|started|created|co-founded|established|owned|run|operated)\s+by\s+"
              r"((?:Dr\.? )?[A-Z][a-zA-Z'’\-]{1,20}(?: [A-Z][a-zA-Z'’\-]{1,20}){1,2})")
LINE_PARTS = r"^(.{3,45}?)\s*[,\-–—|•:/(]\s*(.{3,70})$"
TITLE_LINE_MAX = 110
SOMEONE_ELSES = r",\s*[A-Za-z]|\b(at|of|for)\s+[A-Z]"
LABELLED_CODE = r"^(.*?)\s*\((\d{6})\)\s*$"
QUOTE_TAGS = ["blockquote", "q", "cite"]
QUOTE_CLASSES = ["testimonial", "review", "quote"]
QUOTE_IDS = ["testimonial"]

# -------------------------------------------------------------------------------------------------- fixed values: page roles
HIDDEN_TAGS = ["script", "style", "noscript", "template", "svg"]
PAGE_HINT = r"(?i)contact|about|team|people|leader|founder|company|who-we|our-story|meet|staff|story"
SKIP_PATH = (r"(?i)\.(pdf|jpe?g|png|gif)$|blog|/tag/|/category/|privacy|terms|login|cart|shop|news|press|article|media|career|/jobs?\b|"
             r"/events?\b|webinar|podcast|/posts?\b|case-stud|success-stor|client-stor|customer-stor|testimonial|perspective|insight|"
             r"whitepaper|ebook")
LEGAL_LINK = r"(?i)privacy|terms|legal|imprint|impressum"
LEGAL_PATH = r"(?i)privacy|terms|legal|policy|policies|imprint|impressum|cookie|gdpr|dpa\b"
DEFAULT_PATHS = ["/contact", "/contact-us", "/about", "/about-us", "/team"]
DEFAULT_LEGAL = ["/privacy", "/privacy-policy"]
MAX_SUBPAGES = 6            # role pages of a site: the rule of the fold, and what keeps a site's row small
MAX_LEGAL = 2
FINE_PRINT_PATHS = ["/terms", "/privacy", "/privacy-policy", "/terms-of-service", "/legal", "/contact", "/contact-us", "/about", "/about-us"]
PROFILE_URL = r"(?i)^https?://(?:[a-z]{2,3}\.|www\.)?linkedin\.com/(in|company)/([A-Za-z0-9\-_%.]{2,100})/?$"
PARKED = (r"(?i)domain (is )?for sale|buy this domain|this domain (is|may be) for sale|parked (free|domain)|hugedomains|dan\.com|"
          r"afternic|sedo\.com|domain has expired|account suspended|default web page|under construction|future home of|coming soon")

# -------------------------------------------------------------------------------------------- fixed values: topic classifier
STRONG_SIGNS = [
    r"\bsoftware\b", r"\bsaas\b", r"\bapis?\b", r"\bcloud\b", r"\bcyber ?security\b", r"\bmanaged (it|services)\b",
    r"\bit (services|support|consulting|solutions|infrastructure)\b", r"\bweb (development|design|apps?|hosting)\b",
    r"\bapp (development|developers?)\b", r"\bmobile apps?\b", r"\bmachine learning\b", r"\bartificial intelligence\b",
    r"\b(ai|a\.i\.)[- ](powered|driven|platform|agents?|assistants?|tools?|native|first)\b",
    r"\bdata (platform|engineering|analytics|pipelines?|science|infrastructure|warehouse)\b", r"\bdevops\b",
    r"\bdevelopers?\b", r"\bsoftware engineer", r"\bcustom software\b", r"\bdigital (products?|platforms?|agency)\b",
    r"\bintegrations?\b", r"\bsystems integration\b", r"\bnetwork(ing)? (security|infrastructure)\b",
    r"\bhelp ?desk\b", r"\bplatforms?\b", r"\bweb ?sites?\b", r"\bwordpress\b", r"\bshopify\b", r"\bcoding\b",
    r"\bfull[- ]stack\b", r"\bopen[- ]source\b", r"\bllms?\b", r"\bautomation\b", r"\btelecom", r"\bvoip\b",
    r"\bhosting\b", r"\bdata ?center\b", r"\bgame (studio|development|developer)\b", r"\bgames?\b",
]
WEAK_SIGNS = [r"\btechnolog", r"\bdigital\b", r"\bdata\b", r"\bonline\b", r"\bapps?\b", r"\bweb\b", r"\bai\b", r"\bdesign\b",
              r"\bengineering\b", r"\bstartup\b", r"\bsystems?\b", r"\bconsult"]
OTHER_TRADE_SIGNS = [
    r"\brestaurants?\b", r"\bsalon\b", r"\bbarber", r"\bplumb", r"\bhvac\b", r"\broofing\b", r"\blandscap", r"\bdental\b",
    r"\bclinics?\b", r"\breal estate\b", r"\bboutique\b", r"\bbakery\b", r"\bcaf[eé]\b", r"\byoga\b", r"\bauto (repair|body)\b",
    r"\btires?\b", r"\btowing\b", r"\bcleaning\b", r"\bcatering\b", r"\bmassage\b", r"\bwedding", r"\bphotograph", r"\bapparel\b",
    r"\bjewelry\b", r"\bfitness\b"]

# --------------------------------------------------------------------------------------- fixed values: state table and labels
STATES_OF_COMPANY = ["new", "held", "ready", "pushed", "dropped"]
LISTED = ["ready", "pushed"]
RETRY_DAYS = [0, 3, 10, 30]
TRANSIENT_LIMIT = 3
ESTABLISHED_YEARS = 3
LEGAL_ONLY = "company website (privacy or terms page only)"
ON_SITE = "company website"
IN_FILING = "state registry"
CITY_LICENCE = "city licence"
SOURCE_LABEL = {"tx": "Texas", "ct": "Connecticut", "seattle": "Seattle", "sf": "San Francisco", "la": "Los Angeles"}
FIT_LABEL = {"strong": "Confirmed", "weak": "Likely", "unknown": "Unverified"}
STATUS_LABEL = {"ok": "Done", "partial": "Partly done", "failed": "Failed", "offline": "No internet"}
TRIGGER_LABEL = {"schedule": "Daily schedule", "manual": "Started by hand", "connect": "After connecting Google"}
WHY_PHONE = "phone on the site matches the filing"
WHY_STREET = "street address on the site matches the filing"
WHY_NAME = "full legal name on the site"
WHY_EMAIL = "domain of the email filed with the registry"
WHY_CITY = "site mentions the same city"
WHY_EXACT = "exact name match and the site mentions the same city"
WHY_FINE_STREET = "street address on the site's terms or contact page matches the filing"
WHY_FINE_NAME = "full legal name with the city or ZIP on the site's terms or contact page"
CSV_COLUMNS = [
    ("Company", "company"), ("Website", "website"), ("Email", "email"), ("Phone", "phone"), ("Address", "address"),
    ("Registered", "registered"), ("Contact", "contact"), ("Contact email", "contact_email"), ("LinkedIn", "linkedin"),
    ("Industry", "industry"), ("State", "state"), ("Source", "source"), ("Fit", "fit"), ("Verified by", "proof")]
ILLEGAL_CHARS = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\ufffe\\uffff]"
