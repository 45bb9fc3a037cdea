"""Thresholds and word lists, in one place.

The lists are fixed values: results depend on their members and order.
"""

# --- scores and bands -------------------------------------------------------
RISK_LABEL_HIGH, RISK_LABEL_SUSPICIOUS = 75, 40
LEVEL_LOW_BELOW, LEVEL_HIGH_ABOVE = 0.35, 0.65
SCAM_FROM = 0.65
STORE_ABOVE = 0.6
REPLY_DANGER, REPLY_SUSPICIOUS = 65, 35
HEADLINE_HIGH_ABOVE, HEADLINE_MEDIUM = 60, 30
REPUTATION_SUSPICIOUS_FROM, REPUTATION_CONFIRMED_ABOVE = 1, 3
BROADCAST_FROM = 0.5
SHORT_TEXT_BELOW = 180
SEEN_OFTEN, SEEN_VERY_OFTEN, CHANNELS_MANY = 3, 10, 2
VERDICT_SCORES = {"SAFE": 0.12, "SUSPICIOUS": 0.52, "HIGH_RISK": 0.92}
VERDICT_SYNONYMS = {"SCAM": "HIGH_RISK", "HIGH": "HIGH_RISK", "HIGH-RISK": "HIGH_RISK", "MEDIUM": "SUSPICIOUS", "UNCERTAIN": "SUSPICIOUS"}
DEFAULT_CONFIDENCE, FAILED_CONFIDENCE, DEFAULT_SCORE = 60, 55, 0.52
#: Risk score of a message whose analysis failed.
FAILED_SCORE = 0.5
TYPO_MAX, MATCH_MAX = 3, 2
RATE_LIMIT, RATE_WINDOW_S = 10, 60
DEDUPE_TTL_S = 86_400
#: Lifetimes of a user's reply language and last result.
PREFERENCE_DAYS, LAST_RESULT_DAYS = 30, 7
OCR_GOOD_CONFIDENCE, OCR_PASSES = 50, (6, 11, 3, 4)
TREND_DAYS_MOST = 30
MEDIA_MOST_MB = {"audio": 10, "image": 15, "document": 20}

# --- words ------------------------------------------------------------------
STOP_TOKENS = (
    "salary", "sal", "pay", "wage", "fee", "registration", "call", "contact", "phone", "mobile", "whatsapp", "agent", "broker", "company",
    "urgent", "immediate", "joining", "interview",
)
LOCATIONS = (
    "dubai", "abu dhabi", "doha", "muscat", "qatar", "kuwait", "oman", "bahrain", "saudi", "riyadh", "jeddah", "delhi", "new delhi", "mumbai",
    "navi mumbai", "pune", "hyderabad", "bengaluru", "bangalore", "chennai", "kolkata", "kochi", "kerala", "goa", "lucknow", "jaipur",
    "ahmedabad", "surat", "noida", "gurgaon", "gurugram", "faridabad", "patna", "bhopal", "indore", "nagpur", "kanpur", "vijayawada", "vizag",
    "visakhapatnam",
)
URGENCY_PHRASES = (
    "urgent", "limited seats", "apply today", "apply now", "only today", "last date", "hurry", "immediately", "asap", "do not miss",
    "last chance", "act now", "respond immediately", "jaldi", "abhi", "turant", "kal tak", "aaj",
)
SALARY_WORDS = ("salary", "sal", "pay", "wage", "income")
FEE_WORDS = ("fee", "fees", "registration fee", "service charge", "processing")
ROMAN_HINDI = ("hai", "nahi", "nahin", "kya", "kyu", "kyun", "kaise", "aap", "hum", "paise", "jaldi", "naukri", "farzi", "dhokha")
#: The same for analysed texts.
ROMAN_HINDI_ANALYSIS = ("hai", "nahi", "nahin", "kya", "kyu", "kyun", "kaise", "kripya", "aap", "hum", "paise", "bhejo", "bhejiye", "jaldi", "naukri", "farzi", "dhokha")
COUNTRY_ALIASES = (
    ("uae", "UAE"), ("united arab emirates", "UAE"), ("dubai", "UAE"), ("abu dhabi", "UAE"), ("sharjah", "UAE"), ("qatar", "Qatar"), ("doha", "Qatar"),
    ("saudi", "Saudi Arabia"), ("saudi arabia", "Saudi Arabia"), ("ksa", "Saudi Arabia"), ("riyadh", "Saudi Arabia"), ("jeddah", "Saudi Arabia"),
    ("oman", "Oman"), ("muscat", "Oman"), ("bahrain", "Bahrain"), ("kuwait", "Kuwait"),
)
PHONE_PREFIXES = (
    ("+971", "UAE"), ("+971-50", "UAE"), ("+974", "Qatar"), ("+966", "Saudi Arabia"), ("+968", "Oman"), ("+973", "Bahrain"), ("+965", "Kuwait"),
    ("+91", "India"), ("+91-98", "India"), ("+91-97", "India"), ("", "None"),
)
BRANDS = (
    "Tata Projects", "Tata Consultancy Services", "Tata Motors", "Infosys", "Wipro", "HCL Technologies", "Tech Mahindra", "Larsen and Toubro",
    "L&T", "Reliance Industries", "HDFC Bank", "ICICI Bank", "State Bank of India", "Axis Bank", "Hindustan Unilever", "ITC Limited",
    "Maruti Suzuki", "Mahindra and Mahindra", "Bajaj Auto", "Hero MotoCorp", "BHEL", "ONGC", "NTPC", "Coal India", "SAIL", "GAIL",
)
TRANSCRIPT_URGENCY = ("urgent", "fee", "registration", "limited", "today", "jaldi", "turant", "abhi", "aaj", "kal tak")
LANGUAGE_NAMES = {
    "hi": "Hindi", "en": "English", "bn": "Bengali", "te": "Telugu", "ta": "Tamil", "gu": "Gujarati", "mr": "Marathi", "or": "Odia",
    "pa": "Punjabi", "ur": "Urdu", "ml": "Malayalam", "kn": "Kannada", "unknown": "Unknown",
}
REASONS_HI = {
    "registration fee requested": "रजिस्ट्रेशन फीस मांगी गई है",
    "urgency language detected": "जल्दी निर्णय लेने का दबाव बनाया गया है",
    "salary anomaly": "सैलरी असामान्य रूप से ज्यादा दिखाई गई है",
    "company not identified": "कंपनी की जानकारी सत्यापित नहीं हुई",
    "fee requested": "फीस मांगी गई है",
    "unknown company": "कंपनी की पहचान स्पष्ट नहीं है",
    "analysis failed": "विश्लेषण नहीं हो पाया",
    "empty input": "इनपुट खाली था",
}
REASONS_ROMAN = {
    "registration fee requested": "Registration fee mangi gayi",
    "urgency language detected": "Jaldi apply karne ka dabav banaya gaya",
    "salary anomaly": "Salary asamanya roop se zyada batayi gayi",
    "company not identified": "Company verify nahi hui",
    "fee requested": "Fee mangi gayi",
    "unknown company": "Company verify nahi hui",
}
EDGE_GROUPS = {"phone": (1, "Phone Number"), "upi": (2, "UPI ID"), "agent": (3, "Agent")}
EDGE_OTHER = (3, "Entity")

# The replies: fixed values, in the order danger, doubt, low risk.
REPLY_EN = {
    "title": "Job Safety Check",
    "verdict": "Verdict",
    "score": "Risk Score",
    "why": "Reasons",
    "advice": "Advice",
    "none": "No clear red flags found",
    "verdicts": ("DANGER", "SUSPICIOUS", "LOW RISK"),
    "advices": (
        "Do not send any payment. Verify the company and contact first.",
        "Avoid payment for now. Verify company registration and contact details.",
        "Risk appears low, but still verify details before you act.",
    ),
    "switch": "Reply *HI* to view this in Hindi.",
    "foot": "_We never ask for money, OTP, or Aadhaar._",
}
REPLY_HI = {
    "title": "जॉब सेफ्टी चेक",
    "verdict": "वर्डिक्ट",
    "score": "रिस्क स्कोर",
    "why": "कारण",
    "advice": "सलाह",
    "none": "कोई स्पष्ट रेड फ्लैग नहीं मिला",
    "verdicts": ("खतरा", "संदिग्ध", "कम जोखिम"),
    "advices": (
        "कोई भुगतान न करें। कंपनी और नंबर सत्यापित किए बिना आगे न बढ़ें।",
        "अभी भुगतान न करें। कंपनी पंजीकरण और संपर्क विवरण जांचें।",
        "फिलहाल जोखिम कम लगता है, फिर भी सत्यापन करके ही निर्णय लें।",
    ),
    "switch": "अंग्रेज़ी में देखने के लिए *EN* लिखें।",
    "foot": "_हम कभी पैसे, OTP, या आधार नहीं मांगते।_",
}
