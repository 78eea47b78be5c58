"""The patterns each dialect reads labels with, in the order they are tried.

All are matched without regard to case. (?=...) ends become \\z-terminated look-aheads, since texts
are matched as a whole.
"""

MONTHS = "JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC"
AMOUNT = r"([0-9,]+(?:\.[0-9]{1,2})?)"
DAY = r"(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4})"

# --- service dialect: entities -----------------------------------------------------------------
SERVICE_FSSAI = (
    (r"FSSAI\s*(?:Lic(?:ense)?\.?\s*(?:No\.?)?|No\.?|Number)?\s*[:.]?\s*(\d{14})", "high"),
    (r"Lic(?:ense)?\s*No\.?\s*[:.]?\s*(\d{14})", "medium"),
    (r"\b(\d{14})\b", "low"),
)
SERVICE_PRICE = (
    (r"MRP\s*[:.]?\s*(?:Rs\.?|₹|INR)?\s*" + AMOUNT, "high"),
    (r"(?:Rs\.?|₹)\s*" + AMOUNT, "medium"),
    (r"Price\s*[:.]?\s*" + AMOUNT, "medium"),
)
SERVICE_WEIGHT = (
    (r"Net\s*(?:Wt\.?|Weight|Qty\.?)\s*[:.]?\s*(\d+(?:\.\d+)?)\s*(g|gm|kg|ml|l|ltr)", "high"),
    (r"(\d+(?:\.\d+)?)\s*(g|gm|kg|ml|l|ltr)\s*(?:NET|net)", "high"),
    (r"CONTENTS?\s*[:.]?\s*(\d+(?:\.\d+)?)\s*(g|gm|kg|ml|l)", "medium"),
)
SERVICE_BATCH = r"(?:Batch|Lot|B\.?\s*No\.?|L\.?\s*No\.?)\s*[:.]?\s*([A-Z0-9\-/]+)"
SERVICE_COUNTRY = r"(?:Country\s*of\s*Origin|Made\s*in|Product\s*of)\s*[:.]?\s*([A-Za-z\s]+)"
SERVICE_ADDRESS = (
    r"(?:Mfg\.?\s*(?:by|at)|Manufactured\s*(?:by|at)|Marketed\s*by|Packed\s*(?:by|at)|Importer)\s*[:.]?\s*(.+?)(?=\.|MRP|Batch|Net|\z)",
    r"(?:Address|Regd\.?\s*Office)\s*[:.]?\s*(.+?)(?=\.|MRP|Net|\z)",
)
SERVICE_PHONE = (
    r"(?:Customer\s*Care|Helpline|Toll\s*Free)\s*[:.]?\s*([0-9\-\s]{10,})",
    r"(?:Tel|Phone|Ph)\s*[:.]?\s*([0-9\-\s+()]{10,})",
)
SERVICE_EMAIL = r"(?:Email)\s*[:.]?\s*([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
SERVICE_MADE = "MFG|MFD|MANUFACTURED|PKD|PACKED|DOM|PRODUCTION"
SERVICE_EXPIRES = "EXP|EXPIRY|BEST BEFORE|BB|USE BY|USE BEFORE|VALID TILL|VALID UNTIL|CONSUME BEFORE"
SERVICE_SPAN = r"(\d+)\s*(?:months?|M)"
FULL_MONTHS = "JANUARY|FEBRUARY|MARCH|APRIL|MAY|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER|DECEMBER"
UNITS = {"g": "g", "gm": "g", "gms": "g", "gram": "g", "kg": "kg", "kgs": "kg", "ml": "ml", "l": "L", "ltr": "L", "litre": "L"}
LICENCE_TYPES = {"1": "Central License", "2": "State License", "3": "Registration"}

# --- pattern dialect: name -> (required, patterns) ----------------------------------------------
LABEL = {
    "fssai": (True, (
        r"(?:FSSAI|fssai)\s*(?:Lic(?:ense)?\.?\s*(?:No\.?)?|No\.?|Number)?\s*[:.]?\s*(\d{14})",
        r"(?:License|Lic)\s*(?:No\.?)?\s*[:.]?\s*(\d{14})",
        r"\b([1-3][0-9]\d{12})\b",
    )),
    "mrp": (True, (
        r"MRP\s*[:.]?\s*(?:Rs\.?|₹|INR)?\s*" + AMOUNT,
        r"(?:M\.?R\.?P\.?|Maximum\s*Retail\s*Price)\s*[:.]?\s*(?:Rs\.?|₹)?\s*" + AMOUNT,
        r"(?:Rs\.?|₹)\s*" + AMOUNT + r"\s*(?:only|/-)?",
    )),
    "mfg_date": (True, (
        r"(?:M(?:FG|anufactur(?:ed?|ing))\s*(?:Date)?|MFD|Mfd\.?|DOM)\s*[:.]?\s*" + DAY,
        r"(?:Packed\s*(?:Date|On)|PKD)\s*[:.]?\s*" + DAY,
        rf"(?:MFG|MFD|PKD)\s*[:.]?\s*(\d{{1,2}}\s*(?:{MONTHS})[A-Z]*\s*\d{{2,4}})",
    )),
    "exp_date": (True, (
        r"(?:EXP(?:IRY)?(?:\s*DATE)?|Best\s*Before|BB|Use\s*By)\s*[:.]?\s*" + DAY,
        r"(?:Valid\s*(?:Till|Until|Upto)|Use\s*Before)\s*[:.]?\s*" + DAY,
        rf"(?:EXP|BB)\s*[:.]?\s*(\d{{1,2}}\s*(?:{MONTHS})[A-Z]*\s*\d{{2,4}})",
    )),
    "net_weight": (True, (
        r"(?:Net\s*(?:Wt\.?|Weight|Qty\.?|Quantity)|NW|N\.W\.)\s*[:.]?\s*(\d+(?:\.\d+)?)\s*(g|gm|kg|ml|l|ltr)",
        r"(\d+(?:\.\d+)?)\s*(g|gm|kg|ml|l|ltr)\s*(?:NET|net)",
        r"CONTENTS?\s*[:.]?\s*(\d+(?:\.\d+)?)\s*(g|gm|kg|ml|l)",
    )),
    "batch": (False, (r"(?:Batch|Lot|B\.?\s*No\.?|L\.?\s*No\.?)\s*[:.]?\s*([A-Z0-9\-/]{4,20})",)),
    "country": (True, (
        r"(?:Country\s*of\s*Origin|Made\s*in|Product\s*of)\s*[:.]?\s*([A-Za-z\s]+?)(?=\.|,|MRP|Net|\z)",
        r"(?:MADE|PRODUCT)\s*(?:IN|OF)\s+([A-Z][A-Za-z\s]+?)(?=\.|,|\z)",
    )),
    "customer_care": (False, (
        r"(?:Customer\s*Care|Consumer\s*(?:Helpline|Care)|Toll\s*Free)\s*[:.]?\s*([0-9\-\s]{10,})",
        r"(?:Helpline|Contact)\s*[:.]?\s*(?:\+91|0)?[\s\-]?([0-9\s\-]{10,12})",
    )),
    "allergens": (False, (
        r"(?:Contains?|May\s*Contain)\s*[:.]?\s*([A-Za-z,\s&]+)",
        r"(?:ALLERGEN|WARNING)\s*[:.]?\s*(?:Contains?)?\s*([A-Za-z,\s&]+)",
    )),
    "ingredients": (False, (r"(?:Ingredients?)\s*[:.]?\s*(.+?)(?=\.|Nutritional|Net|MRP|\z)",)),
    "nutrition": (False, (
        r"(?:Energy|Calories)\s*[:.]?\s*(\d+(?:\.\d+)?)\s*(?:kcal|kJ)",
        r"(?:Protein|Carbohydrate|Fat)\s*[:.]?\s*(\d+(?:\.\d+)?)\s*g",
    )),
    "isi_mark": (False, (
        r"(?:ISI|BIS|IS)\s*[:.]?\s*(\d{3,})",
        r"(?:IS|ISI)\s*(\d{3,})\s*[:.]?\s*(?:\d{4})?",
    )),
    "veg_status": (True, (
        r"((?:100\s*%?\s*)?(?:VEGETARIAN|VEG(?:\.)?))",
        r"(NON[\s\-]?VEG(?:ETARIAN)?)",
        r"((?:CONTAINS?\s*)?(?:EGG|MEAT|FISH|CHICKEN))",
    )),
}

# --- OCR dialect ---------------------------------------------------------------------------------
OCR_FSSAI = (
    r"(?:FSSAI|fssai)\s*(?:Lic(?:ense)?\.?\s*(?:No\.?)?|No\.?|Number)?\s*[:.]?\s*(\d{14})",
    r"(?:License|Lic)\s*(?:No\.?)?\s*[:.]?\s*(\d{14})",
    r"(\d{14})(?:\s*(?:FSSAI|fssai))",
    r"(?:भारतीय खाद्य सुरक्षा)\s*[:.]?\s*(\d{14})",
)
OCR_MRP = (
    r"(?:MRP|M\.R\.P|Maximum\s*Retail\s*Price|अधि\.\s*खु\.\s*मू)[:\s]*(?:Rs\.?|₹|INR)?\s*" + AMOUNT,
    r"(?:Rs\.?|₹|INR)\s*" + AMOUNT + r"(?:\s*/\-|\s*only)?",
    r"Price\s*[:.]?\s*(?:Rs\.?|₹)?\s*" + AMOUNT,
    AMOUNT + r"\s*(?:Rs\.?|₹|INR)",
)
OCR_WEIGHT = (
    r"(?:Net\s*(?:Wt\.?|Weight|Qty\.?|Quantity)|NW|N\.W\.|नेट\s*वजन)\s*[:.]?\s*(\d+(?:\.\d+)?)\s*(g|gm|gms|gram|kg|kgs|ml|l|ltr|litre)",
    r"(\d+(?:\.\d+)?)\s*(g|gm|gms|gram|kg|kgs|ml|l|ltr|litre)(?:\s*(?:NET|net|\.))",
    r"CONTENTS?\s*[:.]?\s*(\d+(?:\.\d+)?)\s*(g|gm|gms|gram|kg|kgs|ml|l|ltr|litre)",
)
OCR_BATCH = (
    r"(?:Batch|Lot|B\.?\s*No\.?|L\.?\s*No\.?|बैच)\s*[:.]?\s*([A-Z0-9\-/]+)",
    r"(?:B|L)\s*[:.]?\s*([A-Z0-9]{4,})",
)
OCR_COUNTRY = (
    r"(?:Country\s*of\s*Origin|Made\s*in|Product\s*of|Manufactured\s*in|उत्पादक\s*देश)\s*[:.]?\s*([A-Za-z\s]+)",
    r"(?:MADE|PRODUCT)\s*(?:IN|OF)\s+([A-Z][A-Za-z\s]+)",
)
OCR_CARE = (
    r"(?:Customer\s*Care|Consumer\s*(?:Helpline|Care)|Toll\s*Free|Helpline)\s*[:.]?\s*([0-9\-\s]{10,})",
    r"(?:\+91|0)[\s\-]?([0-9\s\-]{10,12})",
)
OCR_ALLERGENS = (
    r"(?:Contains?|May\s*Contain|Allergen)\s*[:.]?\s*([A-Za-z,\s]+)",
    r"(?:WARNING|CAUTION)\s*[:.]?\s*(?:Contains?)?\s*([A-Za-z,\s]+)",
)
OCR_MADE = r"(?:M(?:FG|anufactur(?:ed?|ing))\s*(?:Date)?|MFD|Mfd\.?|DOM|Date\s*of\s*Mfg\.?|Packed\s*(?:Date|On)|PKD|विनिर्माण)|(?:Best\s*Before|BB|Use\s*By)\s*(?:\d+)\s*(?:months?|M)\s*from"
OCR_EXPIRES = r"(?:EXP(?:IRY)?(?:\s*DATE)?|Best\s*Before|BB|Use\s*By|Use\s*Before|Valid\s*(?:Till|Until|Upto)|समापन\s*तिथि)"
OCR_SHELF_LIFE = r"(?:Best\s*Before|BB|Use\s*(?:By|Within))\s*(\d+)\s*(?:months?|M)"
OCR_DATES = (
    r"\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}",
    rf"\d{{1,2}}\s*(?:{MONTHS})[A-Z]*\s*[,\s]?\s*\d{{2,4}}",
    rf"(?:{MONTHS})[A-Z]*\s*[,\s]?\s*\d{{2,4}}",
    r"\d{4}[/\-]\d{1,2}[/\-]\d{1,2}",
)

# --- declaration dialect: field -> patterns -------------------------------------------------------
_DATE3 = r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}"
_DATES = _DATE3 + r"|[0-9]{1,2}\s*[A-Za-z]{3,9}\s*[0-9]{2,4}|[A-Za-z]{3,9}\s*[0-9]{1,2}[,]?\s*[0-9]{2,4}"
_QUANTITY = r"(?:Net\s*(?:Qty|Quantity|Wt|Weight|Content\s*Volume?)|Item\s*Weight|Weight)\s*[:\-]?\s*"
NET_QUANTITY_RAW = _QUANTITY + r"([^\n|]{5,50})"
UNIVERSAL = {
    "manufacturer_or_importer": (
        r"Manufacturer\s*[:\-]\s*([^\n|,]+)",
        r"(?:Importer|Marketed\s*by|Packed\s*by)\s*[:\-]\s*([^\n|,]+)",
        r"Brand\s*[:\-]\s*([^\n|,]+)",
    ),
    "manufacturer_address": (r"(?:Manufacturer|Mfg\.?|Packed\s*by|Marketed\s*by)\s*[:\-]?\s*(?:[^,\n]+,)?\s*([A-Za-z0-9\s,\.\-]+(?:\d{6}|\d{3}\s*\d{3}))",),
    "importer_address": (r"(?:Importer|Imported\s*by)\s*[:\-]?\s*([^\n]+(?:\d{6}|\d{3}\s*\d{3})?)",),
    "common_generic_name": (
        r"(?:Product\s*(?:Type|Name)|Generic\s*Name|Type|Category)\s*[:\-]?\s*([A-Za-z\s]+)",
        r"((?:Biscuits?|Shampoo|Oil|Rice|Tea|Coffee|Chips?|Chocolate|Cream|Lotion|Soap|Powder|Juice|Drink))",
    ),
    "net_quantity": (
        _QUANTITY + r"([0-9]+(?:\.[0-9]+)?\s*(?:kg|kilogram|g|gram|grams|ml|millilitre|milliliter|millilitres|milliliters|l|litre|litres|liter|liters|pcs|pieces|units?)[s]?)",
    ),
    "mrp_inclusive_of_taxes": (
        r"(?:MRP|M\.R\.P\.?|Maximum\s*Retail\s*Price)\s*[:₹Rs\.\s]*([0-9,]+(?:\.[0-9]{1,2})?\s*(?:incl(?:usive)?\s*of\s*(?:all\s*)?taxes)?)",
    ),
    "consumer_care_information": (
        r"(?:Consumer\s*(?:Care|Complaint|Support)|Customer\s*Care|Contact\s*(?:Us|Info)|Helpline|Toll\s*Free)\s*[:\-]?\s*([^\n|]+)",
    ),
    "date_of_manufacture_or_import": (
        r"(?:Date\s*(?:of\s*)?(?:Manufacture|Mfg|Import|Packing)|Mfg\.?\s*Date|Manufactured\s*on|Imported\s*on|Packed\s*on|Date\s*First\s*Available)\s*[:\-]?\s*(" + _DATES + ")",
    ),
    "country_of_origin": (r"(?:Country\s*of\s*Origin|Made\s*in|Manufactured\s*in|Origin)\s*[:\-]?\s*([A-Za-z ]{2,30})",),
}
FOOD = {
    "fssai_license": (r"(?:FSSAI\s*(?:Lic(?:ense)?\.?\s*)?(?:No\.?)?|License\s*No\.?|Lic\.?\s*No\.?)\s*[:\-]?\s*([0-9]{10,14})",),
    "expiry_date": (r"(?:Exp(?:iry)?\.?\s*Date|Best\s*Before|Use\s*By|BB|Shelf\s*Life)\s*[:\-]?\s*(" + _DATES + r"|[0-9]+\s*(?:months?|days?|years?))",),
    "ingredients_list": (
        r"Ingredients?\s*[:\-]?\s*([^\n]+(?:oil|sugar|salt|water|flour|milk|spice|extract|acid|preservative|vitamin|mineral|refined|soya|rice)[^\n]*)",
    ),
    "nutritional_info": (
        r"Energy\s*\(?(?:kcal)?\)?\s*[:\-]?\s*([0-9]+(?:\.[0-9]+)?\s*(?:kcal|cal|Kilocalories|kJ)?)",
        r"Calories?\s*[:\-]?\s*([0-9]+(?:\.[0-9]+)?[^\n]*)",
    ),
    "allergen_info": (
        r"(?:Allergen(?:s)?(?:\s*Info(?:rmation)?)?|May\s*Contain)\s*[:\-]?\s*([^\n]*(?:nuts?|milk|soy|wheat|gluten|egg|peanut|sesame|fish|shellfish|sulphite|mustard)[^\n]*)",
    ),
    "veg_nonveg_symbol": (r"(?:Ingredient\s*Type|Diet\s*Type)?[:\-]?\s*(Vegetarian|Non[\s\-]?Vegetarian|Veg(?:an)?|Non[\s\-]?Veg)",),
    "batch_lot_number": (r"(?:Batch\s*(?:No\.?)?|Lot\s*(?:No\.?)?|B\.?\s*No\.?)\s*[:\-]?\s*([A-Z0-9\-]{4,})",),
    "storage_instructions": (
        r"(?:Storage|Store|Directions?)\s*[:\-]?\s*([^\n]*(?:cool|dry|refrigerat|freez|temperature|away\s*from|room\s*temp|dark|moisture)[^\n]*)",
    ),
}
ELECTRONICS = {
    "bis_certification": (r"(?:BIS|ISI|Bureau\s*of\s*Indian\s*Standards?)(?:\s*Cert(?:ification)?)?(?:\s*No\.?)?\s*[:\-]?\s*(R-[0-9]+|[A-Z]{2,3}[0-9]+)",),
    "model_number": (r"(?:Model\s*(?:No\.?|Number)?|Item\s*Model)\s*[:\-]?\s*([A-Z0-9\-]+)",),
    "warranty_period": (r"(?:Warranty|Guarantee)\s*[:\-]?\s*([0-9]+\s*(?:year|month|yr|mo)[s]?)",),
    "power_rating": (r"(?:Power|Wattage|Rating)\s*[:\-]?\s*([0-9]+(?:\.[0-9]+)?\s*(?:W|Watt|kW)[s]?)",),
    "voltage_frequency": (r"(?:Voltage|Input|Operating)\s*[:\-]?\s*([0-9]+(?:\-[0-9]+)?\s*V(?:olt)?[s]?(?:\s*[/,]\s*[0-9]+\s*Hz)?)",),
    "energy_rating": (r"(?:Energy\s*(?:Rating|Star)|Star\s*Rating|BEE)\s*[:\-]?\s*([0-9]\s*(?:Star)?s?)",),
    "serial_number": (r"(?:Serial\s*(?:No\.?|Number)?|S\/N)\s*[:\-]?\s*([A-Z0-9\-]{6,})",),
    "safety_instructions": (r"(?:Safety|Warning|Caution)\s*[:\-]?\s*([^\n]+(?:shock|fire|water|heat)[^\n]*)",),
}
COSMETICS = {
    "batch_lot_number": (r"(?:Batch\s*(?:No\.?)?|Lot\s*(?:No\.?)?|B\.?\s*No\.?)\s*[:\-]?\s*([A-Z0-9\-]+)",),
    "expiry_date": (r"(?:Exp(?:iry)?\.?\s*Date|Best\s*Before|Use\s*By|BB)\s*[:\-]?\s*(" + _DATE3 + r"|[A-Za-z]{3,9}\s*[0-9]{2,4})",),
    "ingredients_list": (r"(?:Ingredients?|Contains|Composition)\s*[:\-]\s*([^\n]+(?:\n[^\n]+)?)",),
    "usage_instructions": (r"(?:Usage|How\s*to\s*Use|Directions?|Apply)\s*[:\-]?\s*([^\n]+)",),
    "warnings": (r"(?:Warning|Caution|Note)\s*[:\-]?\s*([^\n]+)",),
    "cruelty_free": (r"(Cruelty[\s\-]?Free|Not\s*Tested\s*on\s*Animals?|Vegan)",),
    "allergen_info": (r"(?:Allergen(?:s)?|Contains|May\s*Contain)\s*[:\-]?\s*([^\n]+)",),
}
PROHIBITED = ("approx", "approximately", "about", "minimum", "min", "average", "avg", "not less than", "atleast", "at least")
SI_UNITS = r"\b(g|gram|grams|kg|kilogram|kilograms|ml|millilitre|millilitres|l|litre|litres|cm|centimetre|m|metre|metres|pcs|pieces|units?)\b"

# --- simple dialect ---------------------------------------------------------------------------------
SIMPLE = {
    "mrp": r"(?:MRP|M\.R\.P\.)\s*[:₹Rs\. ]*\s*(\d+[\.,]?\d*)",
    "quantity": r"(\d+(?:\.\d+)?)\s*(kg|g|gram|grams|ml|l|litre|litres)",
    "manufacturer": r"Manufacturer\s*[:\-]\s*([A-Za-z0-9 ,.&-]+)",
    "country_of_origin": r"(?:Country of Origin|Made in)\s*[:\-]?\s*([A-Za-z ]+)",
}

# --- category detection -------------------------------------------------------------------------------
CATEGORY_KEYWORDS = {
    "food": ["food", "edible", "oil", "snack", "biscuit", "juice", "beverage", "drink", "cereal", "flour", "rice", "dal", "spice", "sauce", "chocolate", "candy", "milk", "dairy", "cheese", "butter", "ghee", "tea", "coffee", "water", "noodle", "pasta"],
    "electronics": ["phone", "mobile", "laptop", "computer", "charger", "cable", "earphone", "headphone", "speaker", "television", "tv", "refrigerator", "fridge", "washing machine", "ac", "air conditioner", "fan", "heater", "iron", "mixer", "grinder", "microwave", "camera", "printer", "router", "power bank", "tablet", "watch", "smart"],
    "cosmetics": ["cream", "lotion", "serum", "shampoo", "conditioner", "soap", "facewash", "face wash", "moisturizer", "sunscreen", "lipstick", "mascara", "foundation", "perfume", "deodorant", "body wash", "hair oil", "gel", "makeup", "nail polish", "skincare", "haircare", "beauty", "cosmetic", "toiletry"],
}
APPLIANCE = r"\b(refrigerator|fridge|washing\s*machine|air\s*conditioner|ac|fan|heater|iron|mixer|grinder|microwave)\b"
IMPORTED = r"\bimport(?:ed|er)?\b"

# --- region dialect: alternatives in the order of their groups ---------------------------------------
_R_DATE = r"[0-9]{1,2}[\/\-\.][0-9]{1,2}[\/\-\.][0-9]{2,4}|[0-9]{1,2}[\/\-][0-9]{2,4}|[A-Za-z]{3,9}[\s,]*[0-9]{1,2}[,]?\s*[0-9]{2,4}|[0-9]{1,2}[\s\-]*[A-Za-z]{3,9}[\s,]*[0-9]{2,4}"
REGION = {
    "mrp": r"(?:MRP|M\.R\.P\.?|Price|PRICE)[\s:₹.]*[₹Rs.]*\s*([0-9,]+(?:\.[0-9]{1,2})?)|[₹][\s]*([0-9,]+(?:\.[0-9]{1,2})?)|Rs\.?\s*([0-9,]+(?:\.[0-9]{1,2})?)",
    "net_quantity": r"(?:Net\s*(?:Wt\.?|Weight|Qty\.?|Quantity|Contents?)|Contents?)[\s:]*([0-9]+(?:\.[0-9]+)?\s*(?:g|gm|gms|kg|kgs|ml|mL|l|L|ltr|litre|liters?|oz|lb)s?)|([0-9]+(?:\.[0-9]+)?\s*(?:g|gm|gms|kg|kgs|ml|mL|l|L|ltr|litre|liters?))\b",
    "manufacture_date": r"(?:Mfg\.?|Mfd\.?|Manufacturing|Manufactured|Packed|Packing|Pkg\.?)[\s:]*(?:Date)?[\s:]*(" + _R_DATE + ")",
    "expiry_date": r"(?:Exp\.?|Expiry|Expires?|Best\s*Before|BB|Use\s*By|Use\s*Before)[\s:]*(?:Date)?[\s:]*(" + _R_DATE + r"|[0-9]+\s*(?:months?|days?|years?)\s*(?:from\s*(?:mfg|manufacturing|packing))?)",
    "country_of_origin": r"(?:Country\s*of\s*Origin|Made\s*in|Product\s*of|Manufactured\s*in|Origin)[\s:]*([A-Za-z]+(?:\s+[A-Za-z]+)?)",
    "manufacturer": r"(?:Mfg\.?\s*(?:by)?|Manufactured\s*by|Packed\s*by|Packer|Marketer|Marketed\s*by)[\s:]*([A-Za-z0-9][A-Za-z0-9\s,\.&\-]+(?:Ltd\.?|Pvt\.?|Inc\.?|LLC|Co\.?|Corporation|Industries)?)",
    "importer": r"(?:Imported\s*by|Importer)[\s:]*([A-Za-z0-9][A-Za-z0-9\s,\.&\-]+(?:Ltd\.?|Pvt\.?|Inc\.?|LLC|Co\.?)?)",
    "consumer_care": r"(?:Consumer\s*Care|Customer\s*Care|Helpline|Contact|Toll\s*Free)[\s:]*([0-9\-\+\s\(\)]{8,20})|(?:1800[\-\s]*[0-9\-\s]{6,12})",
    "batch_number": r"(?:Batch|Lot|B\.?\s*No\.?|L\.?\s*No\.?)[\s:]*([A-Za-z0-9\-\/]{4,20})",
    "fssai_license": r"(?:FSSAI|Lic\.?\s*No\.?|License\s*No\.?)[\s:]*([0-9]{10,14})|\b([0-9]{14})\b",
    "bis_certification": r"(?:BIS|ISI|IS[\s:]*[0-9]+)[\s:]*([A-Za-z0-9\-\/]+)|(?:R-[0-9]{7,})",
}
REGION_DATES = (
    r"([0-9]{1,2}[\/\-\.][0-9]{1,2}[\/\-\.][0-9]{2,4})|"
    r"([0-9]{1,2}[\/\-][0-9]{2,4})|"
    r"([A-Za-z]{3,9}[\s,]*[0-9]{1,2}[,]?\s*[0-9]{2,4})|"
    r"([0-9]{1,2}[\s\-]*[A-Za-z]{3,9}[\s,]*[0-9]{2,4})"
)
