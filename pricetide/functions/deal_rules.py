"""Fixed values for deal titles: word lists, tables and patterns that decide a title's reading.

These must keep exactly these values for titles to be read the same way everywhere.
"""

# --- category -----------------------------------------------------------------
TAG = r"^\s*[\[\(]([^\]\)]{1,40})[\]\)]\s*"
CATEGORY_WORDS = {
    "RAM": r"\b(ram|memory|ddr[345]|dimm|so-?dimm)\b",
    "SSD": r"\b(ssd|nvme|m\.2)\b",
    "CPU": r"\b(cpu|processor|apu)\b",
    "GPU": r"\b(gpu|video ?card|graphics ?card|vga)\b",
}
FLAIRS = {
    "ram": "RAM", "memory": "RAM",
    "ssd": "SSD", "ssd - m.2": "SSD", "ssd - sata": "SSD", "m.2 ssd": "SSD", "nvme": "SSD",
    "cpu": "CPU", "processor": "CPU",
    "gpu": "GPU", "video card": "GPU", "graphics card": "GPU",
}
OTHER_TAG = (
    r"\b(bundle|combo|cooler|cooling|mobo|motherboard|prebuilt|laptop|"
    r"hdd|external|portable|psu|case|monitor)\b"
)
META_TAG = r"\b(meta|psa|question|discussion|iso|wtb|wts|help)\b"
ACCESSORY_TAG = (
    r"\b(block|bracket|riser|cable|support|fans?|backplate|mount|adapter|"
    r"enclosure|heatsink|holder|stand|external|portable|sd|card reader|dock|"
    r"cooler|cooling|thermal|paste|pad)\b"
)
JOINED_TAG = r"[/+&]"

# --- filters ------------------------------------------------------------------
NON_USD = (
    r"(\bCAD\b|\bCDN\b|(?<![A-Za-z])C\$|CA\$|CAN\$|\bAUD\b|(?<![A-Za-z])AU?\$|\bNZD\b|NZ\$|£|€|"
    r"\bGBP\b|\bEUR\b|\bINR\b|₹|\bCanada\b|\bCanadian\b|[\[\(](?:CA|CAN|AU|UK|EU|DE)[\]\)]|"
    r"\bUK\b|\bAustralia)"
)
NON_US_FLAIR = r"canada|\buk\b|australia"
NON_US_ENDINGS = [
    ".ca", ".co.uk", ".uk", ".com.au", ".au", ".de", ".fr", ".it", ".es", ".nl",
    ".in", ".co.nz", ".nz", ".ie", ".jp", ".mx", ".se", ".pl", ".be", ".at", ".ch",
]
NON_US_SITES = [
    "memoryexpress.com", "canadacomputers.com", "ebuyer.com", "ldlc.com", "pccasegear.com", "mightyape.co.nz",
]
USED = (
    r"\b(used|refurb\w*|renewed|recertified|re-certified|pre-?owned|like[- ]new|"
    r"\bb\s?-?\s?stock|grade [abc]\b|reconditioned|second-?hand|ex-?lease|pulls?\b|"
    r"warehouse|scratch (?:and|&) dent|damaged box)"
)
OPEN_BOX = r"open[- ]?box"
RANGE = (
    r"\b(starting at|starts at|start at|(?:starting|prices?|starts?) from|as low as|up to \$|various|"
    r"multiple|assorted|select (?:models|sizes|items)|all sizes|several|lots of|"
    r"sale on|deals on|price drops? on|\d+% off (?:all|select|sitewide))"
)
PACK = r"\b(pack of|\d+[- ]?pack\b|lot of|bulk|qty\.? ?\d|x\s?\d+ units)"
NOT_DEAL = (
    r"^\s*(selling|wts\b|wtb\b|fs:|for sale|psa\b|meta\b|question\b)|\bselling my\b|"
    r"\[(?:iso|meta|psa|wtb|question)\]"
)
PREBUILT = (
    r"\b(laptop|notebook|prebuilt|pre-built|gaming pc|gaming desktop|desktop pc|"
    r"mini pc|steam deck|handheld)\b(?!\s?(?:processor|cpu))"
)
SUSPECT = (
    r"\bebay\b|\bscam\b|too good to be true|is this (?:real|legit)|legit\?|\bfake\b|"
    r"\bstolen\b|price (?:error|mistake)|pricing error|mispric"
)
NOT_DRAM = r"\b(sdxc|sdhc|sd card|micro ?sd|flash|usb|memory card|thumb ?drive|optane)\b"
CONDITIONAL = (
    r"\b(with (?:the )?purchase of|when (?:you )?(?:buy|bought|purchas)|"
    r"add any|with any)\b"
)
COMBO = r"\b(combo|bundled? with (?:a |an )?(?:motherboard|mobo|cpu|ram|ssd))\b"
BUNDLE_WORDS = {
    "RAM": r"\b(motherboard|mobo|cpu|processor|ryzen|core i[3579]|ssd|nvme|gpu|graphics card|rtx|gtx)\b",
    "SSD": (
        r"\b(motherboard|mobo|cpu|processor|ryzen|gpu|graphics card|rtx \d|ddr[45] (?:ram|memory)|"
        r"memory kit|enclosure)\b"
    ),
    "CPU": (
        r"\b(motherboard|mobo|[abxz][4-9][0-9]0[a-z]?\b(?!3d)|b[4-8]50|ddr[45]|\bram\b|memory|ssd|nvme|gpu|"
        r"graphics card|rtx \d|gtx \d|geforce|radeon rx|radeon \d{3,4}|rx \d{3,4}|aio|liquid cooler|"
        r"liquid freezer|kraken|coreliquid|hyper 212|noctua|peerless|assassin)\b"
    ),
    "GPU": (
        r"\b(motherboard|mobo|cpu|processor|ryzen [3579]|core i[3579]|psu|power supply|monitor|"
        r"\bram\b|ddr[45]|ssd|nvme|prebuilt)\b"
    ),
}
PRICE_BOUNDS = {"RAM": (8, 5000), "SSD": (10, 5000), "CPU": (25, 6000), "GPU": (40, 6000)}

# --- price --------------------------------------------------------------------
NUMBER = r"(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d{1,2})|,(\d{2})(?!\d))?"
MONEY = r"(?:US\s?\$|USD\s?\$?|\$)\s?" + NUMBER
MONEY_AFTER = r"(?<![\w.])" + NUMBER + r"(?:\$|\s?usd\b|\s?dollars\b)"
BARE_AMOUNT = (
    r"(?<![\w.$,])(\d{1,3}(?:,\d{3})+|\d{1,5})\.(\d{2})(?![\d%])"
    r"(?!\s?(?:gb|tb|mb|ghz|mhz|v\b|w\b|mm|in\b|\"|inch|ms|hz))"
)
EQUALS = r"=\s*(?:US\s?)?(?:\$\s?" + NUMBER + r"|(?:\d{1,5})\.(?:\d{2})(?!\d))"
DISCOUNT_AFTER = (
    r"^\s*(?:usd\s*)?(?:off|mir|rebate|mail|coupon|promo|instant|gift|gc\b|credit|back|cash ?back|"
    r"shipping|s&h|ship|savings|discount|reward|store credit|in rewards|e-?gift|cheaper|less\b|more\b|"
    r"amazon credit|bonus|for (?:new|first))"
    r"|^\s*(?:(?!(?:with|w|after|using|via|when|at|in|and|before|including|incl|plus)\b)[\w.&'-]+\s){1,2}"
    r"(?:gift ?card|gc\b|credit|rebate|reward|mir\b|discount|off\b)"
)
DISCOUNT_BEFORE = (
    r"(?:save|saving|savings|was|(?:reg\.?|regular|list|retail|orig\.?|original)(?:\s?price)?|regularly|msrp|"
    r"normally|norm|extra|additional|minus|less|\+|plus|get|earn|receive|from|ship(?:ping)?|s&h|after|w/|with|"
    r"by|down from|instead of|vs\.?|compared to|lowest|previous(?:ly)?|usually|typically|avg)\s*:?\s*$"
)

# --- memory -------------------------------------------------------------------
MODULE_SIZES = [2, 4, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256]
LONE_SIZES = MODULE_SIZES + [384, 512, 1024]
KIT_COUNTS = [1, 2, 4, 8]
KIT_COUNT_FIRST = r"\b([1-8])\s?(?:pcs?\s?)?[x×\*]\s?(\d{1,3})\s?(?:gb|g)?\b"
KIT_SIZE_FIRST = r"\b(\d{1,3})\s?(?:gb|g)?\s?[x×\*]\s?([1-8])\b(?!\s?(?:gb|g)\b)"
STATED_SIZE = r"\b(\d{1,4}(?:\.\d)?)\s?(gb|tb)\b(?!\s?/s)"
DDR = r"(?<!lp)(?<!g)ddr\s?-?([345])(?!\d)|\bpc([345])-?\s?\d{5}"
SPEEDS = [
    r"ddr[345]\s?(?:-|\s)?\s?(\d{4})\b",
    r"\b(\d{4})\s?(?:mhz|mt/?s|mts|mt)\b",
    r"\b(\d{4})\s?/?\s?c(?:l)?\s?\d{2}\b",
]
SPEED_RANGE = (1333, 10000)
KNOWN_SPEEDS = [
    1600, 1866, 2133, 2400, 2666, 2667, 2800, 2933, 3000, 3200, 3333, 3466, 3600, 3733, 3800, 3866,
    4000, 4133, 4266, 4400, 4600, 4800, 5200, 5600, 6000, 6200, 6400, 6600, 6800, 7000, 7200, 7600,
    7800, 8000, 8200, 8400, 8800, 9600,
]
CAS = r"(?:\bc(?:l|as)?\s?-?|\d{4}\s?/?\s?c(?:l)?)\s?(\d{2})\b(?!\s?(?:gb|mhz)|-\d)"
CAS_RANGE = (9, 60)
TIMING = r"\b(\d{2})-(\d{2})-(\d{2})(?:-\d{2,3})?\b"
SODIMM = r"so-?dimm|\blaptop\b|\bnotebook\b|260-?pin|262-?pin"
SERVER = r"(?<!non-)(?<!non )\b(ecc|rdimm|registered|lrdimm|server|buffered)\b"
LOW_POWER = r"lpddr|camm"
DDR5_LAUNCH = "2021-11-01"
DDR4_TOP_SPEED, DDR5_LOW_SPEED = 4400, 5200

# --- storage ------------------------------------------------------------------
CAPACITY = r"\b(\d{1,2}(?:\.\d{1,2})?|\d{3,4})\s?(tb|gb|t)\b(?!\s?/?\s?s\b|\s?ps\b)"
CAPACITY_PAIR = r"\b\d+(?:\.\d+)?\s?(?:gb|tb)?\s?/\s?\d+(?:\.\d+)?\s?(?:gb|tb)\b"
CAPACITY_RANGE = (60, 64000)
NVME_WORDS = r"nvme|pcie|pci-e|pci express|\bgen\s?[345]\b|gen[345]x4|\bx4\b"
SATA_WORDS = r"\bsata\b|2\.5\s?(?:\"|”|''|in\b|inch|-inch)|\b2\.5\b"
NVME_MODELS = (
    r"\b(9[789]0 ?(?:evo|pro)(?: plus)?|990|9100|sn\d{3,4}x?|p[1-5](?: plus)?\b|p3[01]0|p31|p41|p44|"
    r"t[57]0[05]|t500|6[67][05]p|sx[68]\d{3}|kc[23]000|nv[123]\b|nm\d{3,4}|fury renegade|"
    r"firecuda 5\d\d|mp[3-7]\d{2}|rocket|ex9\d0|a2000|vi[357]000|g50|mp33|mp44|qn322|ud[89]0|"
    r"p34a|exceria|biwin|nv7400|cras|c910|inland (?:performance|premium|platinum|gaming)|"
    r"hp ex\d{3}|lexar nm|t-force cardea|sn5000|sn7100|sn8100|nextorage|ps5)\b"
)
SATA_MODELS = (
    r"\b(8[67]0 ?(?:evo|qvo|pro)|mx\d{3}|bx\d{3}|a400|sa400|su\d{3}|sa510|"
    r"ssd plus|ultra 3d|wd blue 3d|vulcan z|a55|q500)\b"
)
EXTERNAL = (
    r"\b(external|portable|usb|thunderbolt|enclosure|sd card|microsd|"
    r"micro sd|flash drive|thumb drive|t[579] shield|\bt[579]\b|my passport|"
    r"extreme pro portable|sshd|hybrid|hdd|(?<!solid state )hard drive|optane memory|"
    r"expansion card|xbox)\b"
)
ENTERPRISE = (
    r"\b(u\.2|u\.3|enterprise|data ?center|server|pm9a3|pm983|pm1733|"
    r"micron 5[34]00|micron 7[45]00|d5-p\d|p5[58]\d0|optane)\b"
)
PCIE_GENERATION = r"(?:pcie|pci-e|pci express|gen)\s?-?\s?([345])(?:\.0)?(?:\s?x4)?\b"

# --- processors and graphics --------------------------------------------------
AMD_CPU = (
    r"\b(?:ryzen|threadripper)\s?(?:[3579]|tr)?\s?(?:pro\s)?(?:threadripper\s)?(\d{4})\s?"
    r"(x3d2|x3d|xt|wx|x|ge|g|f)?\b(?!\s?series)|\b(\d{4})(x3d2|x3d|xt|wx|x)\b"
)
INTEL_MARKS = r"\bintel|\bcore\b|\bi[3579]\b|ultra"
INTEL_CORE = r"\bi([3579])\s?-?\s?(\d{4,5})\s?(ks|kf|k|f|t)?\b"
INTEL_BARE = r"\b(1[0-4]\d{3}|[6-9]\d{3})(ks|kf|k|f)\b"
ULTRA = r"\bultra\s?(?:core\s?)?[3579]?\s?(?:processor\s?)?(2\d{2}|3\d{2})\s?(kf|k|f|t)?(\s?plus|p\b)?"
ULTRA_BARE = r"\b(2[2-9]\d)\s?(kf|k)(\s?plus|p\b)?"
NVIDIA_NUMBERS = [
    "1030", "1050", "1060", "1070", "1080", "1630", "1650", "1660", "2060", "2070", "2080",
    "3050", "3060", "3070", "3080", "3090", "4060", "4070", "4080", "4090",
    "5050", "5060", "5070", "5080", "5090",
]
RADEON_NUMBERS = [
    "5500", "5600", "5700", "6400", "6500", "6600", "6650", "6700", "6750", "6800", "6900",
    "6950", "7600", "7650", "7700", "7800", "7900", "9060", "9070",
]
OLD_RADEON_NUMBERS = ["460", "470", "480", "550", "560", "570", "580", "590"]
NVIDIA = r"\b(?:(rtx|gtx|gt)\s?-?\s?)?(\d{4})\s?(ti)?\s?(super)?\b"
RADEON = r"\b(?:(rx)\s?-?\s?)?(\d{3,4})\s?(xtx|xt|gre)?\b"
ARC = r"\b(?:arc\s?)?([ab][3-9][1-8]0)\b"
ARC_MARKS = r"\barc\b|intel"
VEGA = r"\bvega\s?(56|64)\b|\bradeon vii\b"
VRAM = r"\b(\d{1,2})\s?(?:gb?)\b(?!\s?/s)"
VRAM_SIZES = [2, 3, 4, 6, 8, 10, 11, 12, 16, 20, 24, 32]
VRAM_DECIDES = [
    "RTX 3060", "RTX 4060 Ti", "RTX 5060 Ti", "RX 9060 XT", "GTX 1060", "RX 580", "RX 570", "RX 480",
    "RX 470", "RTX 3050", "RTX 2060", "RX 6500 XT", "Arc A770", "GTX 1050 Ti", "RX 7600 XT",
]

# --- comparison bounds --------------------------------------------------------
OUTLIER_BOUNDS = {"unit": (0.25, 5.0), "model": (0.45, 2.2)}
OUTLIER_MIN_ROWS = 5
REPOST_DAYS = 3
