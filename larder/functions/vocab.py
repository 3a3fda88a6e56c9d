"""Word lists, weights, hosts and patterns that results depend on."""

from __future__ import annotations

#: White space as scripts of web pages see it.
WS = r"[\s\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same characters, one by one.
WS_CHARACTERS = " \t\n\x0b\f\r\xa0\ufeff\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word border of ASCII words, whatever letters stand around.
B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: The same where a word begins or ends, next to an ASCII letter or digit of its own.
BEGIN, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

# Food words of titles.
FOOD_WORDS = (
    "chicken beef shrimp prawn prawns crab salmon pork steak sausage turkey tofu rice bowl bowls pasta noodle noodles ramen salad soup curry taco tacos potato potatoes "
    "veggie veggies vegetable vegetables mushroom mushrooms cauliflower broccoli zucchini avocado egg eggs bread muffin muffins waffle waffles pancake pancakes lentil lentils "
    "chickpea chickpeas bean beans quinoa oats banana smoothie cookie cookies cake pie sauce copycat casserole skillet roasted grilled baked fried garlic "
    "butter cheese cheesy stuffed marinade meatball meatballs chili pizza lasagna cabbage cups wraps sandwich burger burgers dessert brownie brownies"
).split(" ") + ["slow cooker", "air fryer"]
FOOD = rf"(?i){BEGIN}(?:{'|'.join(FOOD_WORDS)}){END}"

# Verbs that instructions use; those only at the start are in START_ONLY.
VERBS = (
    "add mix stir cook bake heat pour spread roast broil serve finish combine whisk drizzle garnish assemble marinate marinade preheat place arrange layer toss season top cover "
    "simmer boil grill fry build melt saut(?:e|é) reserve drain nestle spoon use"
).split(" ")
START_ONLY = "slice chop remove transfer fold".split(" ")
INSTRUCTION_VERB = rf"(?iu){BEGIN}(?:{'|'.join(VERBS)}){B}"
INSTRUCTION_START = rf"(?iu)^(?:optional:?{WS}*)?(?:{'|'.join(VERBS + START_ONLY)}){B}"
# What stands around an instruction.
CONTEXT = (
    r"minutes? until bowl pan pot tray dish oven coated tender fragrant golden caramelized halfway lemon brightness sauce serve served seasoning above mixture skillet "
    r"onion garlic generously reserved"
).split(" ") + ["single layer", "baking dish", "air fryer", "remaining butter", "chowder base", "pasta water", "lobster tails?", "chili flakes", "spicy kick"]
INSTRUCTION_CONTEXT = rf"(?i){BEGIN}(?:{'|'.join(CONTEXT)}){END}"
# What measures, categories, counts of reactions, steps after a colon and section heads look like.
MEASURE_START = rf"(?i)^(?:(?:\d+(?:\.\d+)?|\d+/\d+|½|¼|¾|one|two|three|four|five|six){WS}*)?(?:lb|lbs|pound|pounds|oz|ounces?|cup|cups|tbsp|tablespoons?|tsp|teaspoons?|clove|cloves|can|cans|package|packages|stick|sticks){B}"
GENERIC_CATEGORY = rf"(?i)^(?:shrimp|chicken|beef|pork|salmon|fish|seafood|pasta|rice|taco|tacos|soup|salad|dessert|dinner|breakfast|lunch|air fryer|slow cooker|crockpot|keto|healthy|easy|quick|low carb|high protein)(?:{WS}+recipes?)?\z"
ENGAGEMENT_UNIT = r"[\d,.]+\s*[kmb]?\s+(?:views?|reactions?|likes?|comments?|shares?|plays?)"
ENGAGEMENT = rf"(?i)^(?:{ENGAGEMENT_UNIT})(?:\s*[·•|,\-–—]\s*{ENGAGEMENT_UNIT})*\z"
COLON_INSTRUCTION = rf"(?i):\s*(?:in|add|mix|stir|melt|cook|bake|heat|pour|spread|combine|whisk|place|arrange|toss|season|build){B}"
SECTION = r"(?i)ingredients?\s*[:~\-]|instructions?\s*[:~\-]|directions?\s*[:~\-]|method\s*[:~\-]|steps?\s*[:~\-]|macros?\s*[:~\-]|nutrition\s*[:~\-]|serving ideas"

# Parts of titles that are no titles.
GENERIC_TITLES = ["instagram", "instagram recipe", "tiktok", "tiktok recipe", "facebook", "facebook recipe"]
BAD_TITLE_PARTS = [
    " on instagram", " on tiktok", " on facebook", "tiktok - make your day", "make your day", "photos and videos", "watch more", "log in", "sign up",
    "ingredients:", "ingredient:", "instructions:", "directions:", "method:", "steps:", "serving ideas", "macros", "nutrition", "calories", "protein", "carbs", "fat:", "time:", "serving:",
    "follow for", "comment", "save this", "share this", "link in bio", "check out", "take a look", "profile picture",
]
# Tails of captions that end a title.
PROMO_TAILS = [
    "full recipe", "full details", "turn dinner", r"takes? .+ to a whole new level", "step by step", "on my page", "right under my profile picture", "under my profile picture",
    "recipe below", "recipe in caption", "link in bio", "comment for", "follow for",
]
# Weights of caption sources.
SOURCE_WEIGHTS = {"script-caption": 120, "script-caption-text": 115, "script-edge-caption": 110, "og-description": 90, "meta-description": 80, "twitter-description": 75, "article-text": 45, "main-text": 35}
CANONICAL_SOURCES = ["og-description", "meta-description", "twitter-description"]
GENERIC_CAPTIONS = ["see instagram photos and videos", "create an account or log in", "log in to see photos and videos", "from the people you care about", "welcome back to instagram"]

# Tags a recipe may have, and those of a plan request.
RECIPE_TAGS = (
    "air-fryer asian beef breakfast casserole chicken comfort crockpot dessert dinner easy family fish freezer-friendly gluten-free grilling healthy italian kid-friendly low-carb "
    "lunch mexican one-pot oven pasta pork quick rice salad seafood sheet-pan side slow-cooker soup spicy stovetop tacos vegetarian"
).split(" ")
PLAN_TAGS = (
    "chicken beef pork seafood fish pasta rice tacos soup salad casserole comfort family kid-friendly quick easy oven stovetop slow-cooker crockpot air-fryer grilling sheet-pan "
    "one-pot vegetarian healthy spicy italian mexican asian freezer-friendly gluten-free low-carb"
).split(" ")

# Words broken by line ends, in order, and their repair.
BROKEN_WORDS = [
    (r"th\s+e", "the"), (r"wh\s+en", "when"), (r"ov\s+er", "over"), (r"und\s+er", "under"), (r"rem\s+aining", "remaining"), (r"tom\s+atoes", "tomatoes"), (r"to\s+matoes", "tomatoes"),
    (r"ch\s+icken", "chicken"), (r"bl\s+ack", "black"), (r"b\s+lack", "black"), (r"l\s+ack", "black"), (r"cl\s+ove", "clove"), (r"fr\s+esh", "fresh"), (r"mozz\s+arella", "mozzarella"),
    ("oregano", "oregano"), ("regano", "oregano"),
]
# Entities and their characters, in the order they are decoded.
ENTITIES = [
    ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("&#39;", "'"), ("(?i)&quot;", '"'), ("(?i)&rsquo;", "'"), ("(?i)&lsquo;", "'"), ("(?i)&rdquo;", '"'), ("(?i)&ldquo;", '"'),
    ("(?i)&frac12;", "½"), ("(?i)&frac14;", "¼"), ("(?i)&frac34;", "¾"), ("&#160;", " "), ("&#176;", "°"), ("&#188;", "¼"), ("&#189;", "½"), ("&#190;", "¾"),
    ("&#8217;", "'"), ("&#8216;", "'"), ("&#8220;", '"'), ("&#8221;", '"'),
]
SIMPLE_ENTITIES = [e for e in ENTITIES if "frac" not in e[0] and e[0] not in ("&#160;", "&#176;", "&#188;", "&#189;", "&#190;")]
# Steps that are no steps.
STEP_NOISE = [
    "pro tip:", "this soup freezes", "this allows leftover", "this will yield", r"refer to package", r"\(?refer to package", "see this video", "any rice stuck", "note: other varieties of rice",
]
# Words of an ingredient line that name no ingredient.
MEASURE_WORDS = (
    "cup cups tbsp tablespoons? tsp teaspoons? lb lbs pound pounds oz ounce ounces can cans jar jars package packages small medium large fresh dried chopped minced sliced diced to taste for with and the"
).split(" ")
# Verbs that page steps hold and promotion that they do not.
STEP_VERBS = "mix stir cook bake heat place add whisk combine pour season serve remove transfer drain spread sprinkle preheat".split(" ")
STEP_PROMOS = "watch video subscribe newsletter follow instagram youtube".split(" ")
# Signs of challenge pages.
BLOCKED_TITLES = ["just a moment", "access denied", "access to this page has been denied"]
BLOCKED_BODIES = [
    "just a moment", "checking your browser", "access to this page has been denied", "please enable cookies", "verify you are human", "attention required", "blocked by network security", "whoa there, pardner",
]
BLOCKED_URLS = ["js_challenge=1", "solution="]
# Hosts, query keys and error codes.
SOCIAL_HOSTS = ["facebook.com", "fb.watch", "instagram.com", "tiktok.com", "pinterest.com"]
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid"]
PIN_TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid", "igshid", "ref"]
REDIRECTS = ["u", "url", "target", "redirect", "redirect_url", "next"]
SOURCE_STEPS = "Steps available at source link!"
PINTEREST_HOSTS = ["pinterest.com", "www.pinterest.com", "pin.it"]
BAD_HOST_FRAGMENTS = [
    "pinterest.", "pinimg.com", "facebook.com", "instagram.com", "tiktok.com", "youtube.com", "youtu.be", "chromewebstore.google.com", "chrome.google.com", "googleusercontent.com", "gstatic.com",
]
TIKTOK_HOSTS = ["tiktok.com", "www.tiktok.com", "m.tiktok.com", "vm.tiktok.com", "vt.tiktok.com"]
INVALID_URL_CODES = ["INVALID_PUBLIC_VIDEO_URL", "UNSUPPORTED_PUBLIC_VIDEO_PLATFORM", "UNSUPPORTED_INSTAGRAM_PATH", "INVALID_TIKTOK_URL", "INVALID_TIKTOK_PROTOCOL", "UNSUPPORTED_TIKTOK_HOST"]
UNAVAILABLE_CODES = ["PUBLIC_VIDEO_NOT_FOUND", "PUBLIC_VIDEO_NO_RECIPE_FOUND", "TIKTOK_CAPTION_UNAVAILABLE", "TIKTOK_OEMBED_FAILED"]
# Where pages keep captions: metas, then patterns of scripts, with their sources.
CAPTION_METAS = [("property=og:description", "og-description"), ("name=description", "meta-description"), ("name=twitter:description", "twitter-description")]
CAPTION_SCRIPTS = [
    ("script-caption", r'"caption"\s*:\s*\{\s*"text"\s*:\s*"((?:\\.|[^"\\])*)"'),
    ("script-caption-text", r'"caption_text"\s*:\s*"((?:\\.|[^"\\])*)"'),
    ("script-edge-caption", r'"edge_media_to_caption"\s*:\s*\{[\s\S]{0,1600}?"text"\s*:\s*"((?:\\.|[^"\\])*)"'),
]
LONGEST_CAPTION_SCRIPT = 5_000_000
# Where pages keep media.
MEDIA_METAS = ["og:video", "og:video:url", "og:video:secure_url", "twitter:player:stream"]
SCRIPT_URL = r"""(?i)https?:\\?/\\?/[^"'\\\s<>]+"""
LONGEST_MEDIA_SCRIPT = 3_000_000
# Sources of a video's title, and names that name no recipe.
TITLE_SOURCES = ["visible", "spoken", "visible-and-spoken", "unknown"]
GENERIC_NAMES = ["", "imported recipe", "saved recipe", "screenshot recipe", "recipe"]
