"""Word lists, extensions and types that results depend on."""

# Query parameters that only track; everything that begins with utm_ does too.
TRACKING = ("_rsc", "ref", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid", "mc_cid", "mc_eid")
# Prefixes of references that lead to no document.
OTHER_SCHEMES = ("javascript:", "mailto:", "tel:", "data:", "blob:")
# Extensions of files that are stored as assets.
ASSET_EXTENSIONS = ("css", "js", "mjs", "woff", "woff2", "ttf", "otf", "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "avif", "mp4", "webm")
# Extensions of images.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "avif")
# Content types of scripts.
SCRIPT_TYPES = ("application/javascript", "text/javascript", "application/x-javascript")
# How paths of requests that can't be stored look.
DYNAMIC_HINTS = (("startswith", "/api/"), ("startswith", "/cdn-cgi/"), ("contains", "/__cf_"), ("endswith", "/rum"), ("contains", "cloudflareinsights"))
# Browser resource types that are files, and those that are live requests.
STATIC_TYPES = ("Document", "Stylesheet", "Script", "Image", "Font", "Media", "Manifest")
DYNAMIC_TYPES = ("Fetch", "Xhr", "EventSource", "WebSocket", "Other")
# Marks of pages that a script builds in the browser, and the ids of their roots.
SPA_MARKERS = ("__next_data__", "__next_f", "__nuxt__", "ng-version", "data-reactroot", "data-react-root", "data-server-rendered", "vite-plugin-pwa", "registersw", "data-v-app")
SPA_ROOTS = ("root", "app", "__next", "__nuxt", "q-app", "__vue")
# Element and attribute pairs that hold assets, in order of extraction.
ASSET_ATTRIBUTES = (
    ("link", "href"), ("script", "src"), ("img", "src"), ("source", "src"), ("video", "src"), ("audio", "src"),
    ("img", "data-src"), ("img", "data-lazy-src"), ("source", "data-src"), ("source", "data-lazy-src"), ("video", "poster"),
    ("iframe", "src"), ("embed", "src"), ("object", "data"), ("track", "src"), ("input", "src"),
)
# Element and attribute pairs of a rendered document that name resources.
DOM_RESOURCES = (("link", "href"), ("script", "src"), ("img", "src"), ("source", "src"), ("video", "src"), ("audio", "src"))
# Attributes whose quoted value is a link, and those that hold several candidates.
LINK_ATTRIBUTES = ("href", "src", "action", "poster", "data-src", "data-lazy-src")
SRCSET_ATTRIBUTES = ("srcset", "data-srcset")
# Link relations that break offline pages (preload only for scripts), names of service worker files in lower case, and calls that start one.
DROPPED_LINKS = ("manifest", "modulepreload", "preload")
WORKER_FILES = ("registersw", "workbox", "swregister", "sw-register", "sw.js")
WORKER_CALLS = ("serviceWorker", "registerSW", "workbox")
# Types of scripts that hold data.
DATA_SCRIPTS = ("application/ld+json", "text/template", "speculationrules", "application/json")
# Characters that file names can't hold.
UNSAFE = "/\\:*?\"<>|"
# A file's name in the archive listing that is left out.
MANIFEST_NAME = ".site-manifest.json"
