"""The sample query, vocabulary and profile the catalogue runs with."""

from wayfind.plans.query import GENERIC, QueryPlan
from wayfind.sources.profile import TableProfile

QUERY_TEXT = "Where does the HehelyOrantion service handle inoran rewh permission flow in src3?"

MODULE_VOCABULARY = {
    "en": ("inoran", "rewh", "hehely", "orantion", "ononst", "with"),
    "fr": ("elle", "ment", "pour", "dans"),
    "de": ("sich", "keit", "lich", "heit"),
    "es": ("para", "como", "pero", "cion"),
}
SYNONYMS = {"permission": ("thatin", "access"), "elle": ("ment",), "service": ("orre",)}
MODULE_PATHS = [("/services/", "en"), ("/controllers/", "fr"), ("/jobs/", "de")]
NOISE_FILES = {
    "ui_shell": ("app.tsx", "layout.tsx"),
    "frontend_support": ("client.ts", "api.ts", "store.ts"),
    "backend_root": ("program.cs", "startup.cs"),
}
GAP_TABLE = [(("thatin", "inoran"), "inoran service thatin"), (("keit",), "keit controller")]
PINS = [(("permission",), ("app/brand2/Services/RedWidget1Service.cs", "app/brand3/Jobs/BlueBolt2Job.cs"))]

PROFILE = TableProfile(
    name="sample",
    synonyms=SYNONYMS,
    modules=MODULE_VOCABULARY,
    pins=PINS,
    module_paths=MODULE_PATHS,
    low_signal=("rewh",),
    noise=NOISE_FILES,
    gaps=GAP_TABLE,
    owner_patterns=("hook.ts",),
)
#: The plans of two texts, written out so that the SQL twins do not depend on the code they check (a test compares them).
PLAN = QueryPlan(
    text=QUERY_TEXT,
    tokens=("hehely", "orantion", "service", "handle", "inoran", "rewh", "permission", "flow", "in", "src3", "thatin", "access", "orre"),
    identifiers=("HehelyOrantion", "src3"),
    affirmed=("HehelyOrantion", "src3"),
    named_files=frozenset(),
    modules=frozenset(("en",)),
    dominant=frozenset(("en",)),
    intents=frozenset(("business_flow", "code_level", "implementation_trace", "ownership", "runtime_debug")),
    query_profile="code_debug",
    generic=GENERIC | frozenset(MODULE_VOCABULARY),
    pins=("app/brand2/Services/RedWidget1Service.cs",),
    strict=("HehelyOrantion", "src3"),
    strict_affirmed=("HehelyOrantion", "src3"),
    owner_words=("flow", "handle", "hehely", "in", "inoran", "orantion", "permission", "rewh", "service", "src3"),
)
SYMBOL_TEXT = "Which service or controller handles Order1234 and the widget, not Order77?"
SYMBOL_PLAN = QueryPlan(
    text=SYMBOL_TEXT,
    tokens=("which", "service", "or", "controller", "handles", "handle", "order1234", "widget", "not", "order77"),
    identifiers=("Which", "Order1234", "Order77"),
    affirmed=("Which",),
    named_files=frozenset(),
    modules=frozenset(),
    dominant=frozenset(),
    intents=frozenset(("code_level", "implementation_trace", "ownership")),
    query_profile="code_debug",
    generic=GENERIC,
    strict=("Order1234", "Order77"),
    strict_affirmed=(),
    owner_words=("controller", "handle", "handles", "not", "or", "service", "which", "widget"),
)
#: How far the query's other words back each of these identifiers.
SYMBOL_STRENGTH = {"Which": 0.4, "Order1234": 0.4, "Order77": 0.4}
