"""Word lists as data. All of them are parameters of the functions that use them; these are the defaults."""

# Words that name an offer, by kind, in the order they are reported.
OFFER_WORDS = {
    "free": [
        "免费", "限时免费", "免费领", "免费用", "0元", "零元", "1元", "一元", "白嫖", "免单", "免费额度", "免费试用", "免费送", "无限免费", "永久免费", "免费开放", "全部免费", "开放试用",
        "free", "for free", "free tier", "free access", "free credits", "free quota", "no charge", "no cost", "$0", "at no cost", "100% off", "unlimited free", "zero cost", "no fee",
        "costs nothing", "free for", "now free",
    ],
    "discount": [
        "折扣", "打折", "半价", "立减", "直降", "特惠", "特价", "秒杀", "促销", "满减", "降价", "一折", "二折", "三折", "四折", "五折", "六折", "七折", "八折", "九折", "骨折价", "白菜价",
        "抄底价", "限时特惠", "大促", "补贴价", "discount", "% off", "sale", "promo", "promotion", "bogo", "buy one", "price drop", "reduced price", "flash sale", "half price",
    ],
    "credit": [
        "赠送", "送额度", "代金券", "体验金", "充值送", "礼包", "免费领取", "签到", "积分兑换", "补贴", "credits", "signup bonus", "starter credit", "free credit", "rebate", "cashback",
    ],
    "trial": ["试用", "免费体验", "公测", "内测", "抢先体验", "free trial", "trial", "beta access", "early access", "preview access"],
    "coupon": ["优惠券", "兑换码", "优惠码", "折扣码", "邀请码", "券码", "卡密", "coupon", "promo code", "voucher", "discount code"],
}

# Topics that are never offers.
NOISE_WORDS = ["招聘", "求职", "相亲", "二手房", "租房", "贷款", "博彩", "彩票", "投资有风险", "代购", "微商", "演唱会门票", "hiring", "job offer", "recruit"]

# Words that name a vendor, by vendor; matched as plain substrings, in byte order of the words.
VENDOR_WORDS = {
    "智谱AI": ["智谱", "glm", "chatglm", "bigmodel"],
    "阿里云": ["通义", "百炼", "qwen", "aliyun", "alibaba cloud"],
    "DeepSeek": ["deepseek"],
    "火山引擎": ["豆包", "火山引擎", "doubao", "volcengine", "ark"],
    "月之暗面": ["kimi", "moonshot"],
    "MiniMax": ["minimax", "hailuo"],
    "百度智能云": ["文心", "ernie", "千帆"],
    "腾讯云": ["混元", "hunyuan"],
    "科大讯飞": ["星火", "spark llm"],
    "阶跃星辰": ["阶跃", "stepfun"],
    "昆仑万维": ["天工", "skysense"],
    "硅基流动": ["siliconflow", "硅基流动"],
    "OpenRouter": ["openrouter"],
    "Ollama": ["ollama"],
    "Anthropic": ["anthropic", "claude"],
    "OpenAI": ["openai", "chatgpt"],
    "Google": ["gemini", "vertex ai", "colab"],
    "Mistral": ["mistral", "le chat"],
    "xAI": ["grok", "xai"],
    "Meta": ["llama"],
    "Groq": ["groq"],
    "Together": ["together ai"],
    "Fireworks": ["fireworks ai"],
    "NVIDIA": ["nvidia nim", "ngc"],
    "AWS": ["aws", "bedrock"],
    "Azure": ["azure"],
    "GCP": ["gcp"],
    "Cloudflare": ["cloudflare"],
    "Vercel": ["vercel"],
    "Netlify": ["netlify"],
    "GitHub": ["github", "copilot", "codespaces"],
    "JetBrains": ["jetbrains"],
    "Oracle": ["oracle"],
    "Vultr": ["vultr"],
    "Hetzner": ["hetzner"],
    "RackNerd": ["racknerd"],
    "京东": ["京东"],
    "淘宝": ["淘宝"],
    "拼多多": ["拼多多"],
    "美团": ["美团"],
    "饿了么": ["饿了么"],
    "网易云音乐": ["网易云音乐"],
    "B站": ["b站", "哔哩哔哩"],
    "夸克": ["夸克", "quark"],
    "迅雷": ["迅雷"],
    "WPS": ["wps"],
    "百度网盘": ["百度网盘"],
    "阿里云盘": ["阿里云盘"],
    "Notion": ["notion"],
    "Figma": ["figma"],
    "Canva": ["canva"],
    "1Password": ["1password"],
    "Hugging Face": ["huggingface"],
    "魔搭": ["modelscope"],
    "飞书": ["飞书"],
    "钉钉": ["钉钉"],
}


def vendor_needles() -> list[tuple[str, str]]:
    """(word, vendor) in byte order of the words."""
    return sorted((w, v) for v, ws in VENDOR_WORDS.items() for w in ws)


# A versioned product name, and titles that doubt an offer.
PRODUCT = (
    r"(?i)\b(?:glm|chatglm|qwen|deepseek|kimi|moonshot|doubao|ernie|hunyuan|spark|yi|step|minimax|hailuo|claude|gpt|gemini|mistral|grok|llama|groq|o)"
    r"[-_ ]?v?\d+(?:\.\d+)*(?:[-.][a-z0-9]{1,12})*"
)
DOUBT = r"吐槽|求助|是不是|有没有|该选|如何评价|值不值|翻车|失望|求佬?解答|求指导|(^|[^申])请教|求推荐|帮我看看"

# Title words that make no search term, and HTML entities by name.
STOP_WORDS = ["最新", "今日", "刚刚", "宣布", "官方", "活动", "链接", "http", "https", "com", "www"]
ENTITIES = {
    "nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "hellip": "…", "mdash": "—", "ndash": "–", "rsquo": "’", "lsquo": "‘",
    "rdquo": "”", "ldquo": "“", "middot": "·", "bull": "•", "trade": "™", "reg": "®", "copy": "©", "plusmn": "±", "times": "×", "divide": "÷",
    "deg": "°", "laquo": "«", "raquo": "»", "darr": "↓", "uarr": "↑", "rarr": "→", "larr": "←", "harr": "↔", "euro": "€", "pound": "£",
    "curren": "¤", "yuml": "ÿ", "sect": "§", "para": "¶", "dagger": "†", "permil": "‰", "prime": "′", "lsqb": "[", "rsqb": "]", "brvbar": "¦", "shy": "",
}

# Categories of entry pages tried in order for what an offer is. Domains and pages of vendors are tables that a caller gives.
PAGE_ORDER = {
    "free": ["free", "credits", "benefit", "activity", "plans", "pricing"],
    "credit": ["free", "credits", "benefit", "activity", "plans", "pricing"],
    "trial": ["free", "credits", "benefit", "activity", "plans", "pricing"],
    "coupon": ["free", "credits", "benefit", "activity", "plans", "pricing"],
    "discount": ["pricing", "plans", "activity", "benefit"],
    "": ["pricing", "plans", "docs", "activity"],
}
