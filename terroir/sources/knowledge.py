"""Agronomic knowledge tables.

FIXED VALUES: everything in this module is a value that must equal the agronomic
rule set this engine reproduces (thresholds, crop profiles, rule tables, message
texts).  They are stated plainly, in their natural order, and turned into small
broadcastable DataFrames / literal column expressions by ``dims.py``.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES - validation bounds and thresholds
# ---------------------------------------------------------------------------
HARD_BOUNDS = {            # column: (lower, upper) - a violation makes the table CRITICAL
    "ph": (0.0, 14.0),
    "moisture": (0.0, 100.0),
    "temperature": (-10.0, 60.0),
    "humidity": (0.0, 100.0),
    "rainfall": (0.0, 5000.0),
}
SOFT_BOUNDS = {            # column: (lower, upper) - a violation makes the table WARN
    "N": (0.0, 200.0),
    "P": (0.0, 200.0),
    "K": (0.0, 200.0),
}
ROW_BOUNDS = {             # per-record validation bounds (None = open side)
    "N": (0.0, 200.0),
    "P": (0.0, 200.0),
    "K": (0.0, 200.0),
    "ph": (0.0, 14.0),
    "ec": (0.0, None),
    "organic_carbon": (0.0, None),
    "moisture": (0.0, 100.0),
    "temperature": (-10.0, 60.0),
    "humidity": (0.0, 100.0),
    "rainfall": (0.0, 5000.0),
}
SEASONS = ["kharif", "rabi", "summer"]
DEFICIENCY_THRESHOLDS = {"N": 40.0, "P": 20.0, "K": 30.0}
FERTILIZER_LOWS = {"N": 20.0, "P": 10.0, "K": 15.0}
PH_OK = (5.5, 7.5)
MOISTURE_LOW, MOISTURE_HIGH, MOISTURE_URGENT = 25.0, 75.0, 15.0
REMOVAL_LIMIT = 0.20
IQR_K = 1.5
Z_THRESHOLD = 3.0
SPLIT_SHARES = (0.70, 0.15, 0.15)
SEED = 42

# ---------------------------------------------------------------------------
# FIXED VALUES - class domains
# ---------------------------------------------------------------------------
CROP_CLASSES = [  # sorted, the index is the class code
    "apple", "banana", "blackgram", "chickpea", "coconut", "coffee", "cotton", "grapes",
    "jute", "kidneybeans", "lentil", "maize", "mango", "mothbeans", "mungbean", "muskmelon",
    "orange", "papaya", "pigeonpeas", "pomegranate", "rice", "watermelon",
]
FERTILITY_CLASSES = ["Low", "Medium", "High"]
DEFICIENCY_CLASSES = ["Balanced", "Nitrogen deficient", "Phosphorus deficient", "Potassium deficient"]

# ---------------------------------------------------------------------------
# FIXED VALUES - crop agronomic profiles, in profile order
# name: (rain lo, rain hi, temp lo, temp hi, humidity lo, humidity hi, ph lo, ph hi, seasons, duration)
# ---------------------------------------------------------------------------
CROP_PROFILES = [
    ("rice", 1200, 3000, 20, 38, 70, 95, 5.0, 7.0, ["kharif"], "seasonal"),
    ("maize", 500, 1500, 18, 32, 55, 80, 5.5, 7.5, ["kharif", "rabi"], "seasonal"),
    ("chickpea", 300, 700, 15, 28, 30, 60, 6.0, 8.0, ["rabi"], "seasonal"),
    ("kidneybeans", 400, 1000, 15, 25, 40, 70, 5.5, 6.5, ["rabi"], "seasonal"),
    ("pigeonpeas", 600, 1200, 18, 35, 45, 80, 5.0, 7.5, ["kharif"], "seasonal"),
    ("mothbeans", 200, 500, 25, 40, 30, 60, 6.0, 7.5, ["kharif"], "seasonal"),
    ("mungbean", 400, 900, 20, 35, 40, 70, 6.0, 7.5, ["summer", "kharif"], "seasonal"),
    ("blackgram", 600, 1000, 25, 35, 45, 80, 6.0, 7.5, ["kharif", "rabi"], "seasonal"),
    ("lentil", 350, 700, 10, 25, 30, 60, 6.0, 8.0, ["rabi"], "seasonal"),
    ("pomegranate", 500, 1200, 15, 35, 30, 60, 5.5, 7.5, ["perennial"], "perennial"),
    ("banana", 1500, 3000, 20, 35, 65, 90, 5.5, 8.0, ["perennial"], "perennial"),
    ("mango", 750, 1500, 20, 36, 40, 75, 5.5, 7.0, ["perennial"], "perennial"),
    ("grapes", 400, 1000, 15, 32, 30, 65, 6.0, 7.5, ["perennial"], "perennial"),
    ("watermelon", 300, 800, 22, 35, 35, 65, 5.5, 7.0, ["summer"], "seasonal"),
    ("muskmelon", 300, 800, 20, 35, 35, 65, 5.5, 7.0, ["summer"], "seasonal"),
    ("apple", 600, 1500, 5, 25, 40, 70, 5.5, 6.8, ["perennial"], "perennial"),
    ("orange", 800, 1600, 15, 32, 45, 80, 5.5, 7.5, ["perennial"], "perennial"),
    ("papaya", 1000, 2000, 22, 35, 60, 85, 6.0, 7.0, ["perennial"], "perennial"),
    ("coconut", 1000, 2500, 20, 35, 60, 90, 5.0, 8.0, ["perennial"], "perennial"),
    ("cotton", 500, 1200, 22, 35, 50, 80, 5.5, 8.5, ["kharif"], "seasonal"),
    ("jute", 1200, 2500, 24, 38, 70, 95, 6.0, 7.5, ["kharif"], "seasonal"),
    ("coffee", 1000, 2200, 15, 28, 60, 85, 5.0, 6.5, ["perennial"], "perennial"),
]
# Baseline nutrient thresholds used by the suitability and narrative rules.
NUTRIENT_LOW = {"N": 50.0, "P": 30.0, "K": 35.0}
PH_ACIDIC, PH_ALKALINE = 5.8, 7.3

# Suitability texts (the number in braces is formatted with one decimal).
SUIT_TEXT = {
    "rain_ok": "Optimal rainfall ({rain} mm) matches water requirements.",
    "rain_low_limit": "Insufficient rainfall ({rain} mm vs ideal {lo} mm).",
    "rain_low_risk": "Moisture stress risk requires crop irrigation support.",
    "rain_high_risk": "High rainfall risk could lead to waterlogging or root damage.",
    "temp_ok": "Ideal climate temperature ({temp}°C) supports growth phases.",
    "temp_limit": "Temperature exposure ({temp}°C) is outside optimal {lo}-{hi}°C.",
    "temp_risk": "Thermal stress may affect yield or flowering rates.",
    "hum_ok": "Optimal atmospheric humidity ({hum}%) regulates transpiration.",
    "hum_risk": "Suboptimal humidity ({hum}%) might promote fungal diseases.",
    "ph_ok": "Soil acidity level (pH {ph}) enables optimal nutrient absorption.",
    "ph_limit": "Soil pH {ph} is outside crop's ideal range ({lo}-{hi}).",
    "ph_risk": "Altered pH reduces bioavailability of critical soil micronutrients.",
    "low_n": "Low nitrogen will restrict vegetative growth.",
    "low_p": "Low phosphorus blocks robust root establishment.",
    "low_k": "Low potassium reduces natural drought resistance.",
    "season_ok": "Aligned with seasonal context ({Season} crop).",
    "perennial_limit": "Perennial {Crop} requires long-term water, but rain-fed rain is insufficient.",
    "perennial_risk": "Severe long-term soil moisture depletion risk.",
    "perennial_ok": "Perennial crop with stable year-round growth profile.",
    "season_limit": "Mismatched season (sowing {Crop} in {Season} is non-traditional).",
    "season_risk": "Sowing {Crop} in {Season} leads to cycle mismatch.",
    "no_adv": "Soil holds baseline compatibility.",
    "no_risk": "No critical agronomic risks predicted.",
    "no_limit": "No critical climatic limits observed.",
    "avoid_default": "Mismatched soil/climate parameters.",
}

# ---------------------------------------------------------------------------
# FIXED VALUES - spatial rules
# ---------------------------------------------------------------------------
CROP_TAG_MODIFIERS = {  # crop: (bonus tags, penalty tags, bonus text, penalty text)
    "rice": (["coastal", "delta_region", "high_rainfall", "canal_irrigation", "humid_coastal", "clay", "kharif"],
             ["arid", "dry_zone", "drought_prone", "sandy", "rain_fed"],
             "coastal/delta conditions and high water availability align strongly with paddy cultivation.",
             "dry-zone context and lower water availability reduces confidence for rice cultivation."),
    "wheat": (["dry_plains", "irrigated_zone", "rabi", "loamy"],
              ["flood_sensitive", "high_rainfall", "humid_coastal", "kharif"],
              "dry-zone context and cooler conditions favor wheat cultivation.",
              "wheat is less suited to humid coastal or flood-prone environments."),
    "cotton": (["semi_arid", "black soil", "kharif"],
               ["high_rainfall", "flood_sensitive", "humid_coastal"],
               "semi-arid conditions and black soil strongly favor cotton.",
               "high rainfall and flood risks are detrimental to cotton bolls."),
    "sugarcane": (["canal_irrigation", "high_rainfall", "delta_region", "clay"],
                  ["drought_prone", "arid", "rain_fed", "sandy"],
                  "abundant water and heavy soils are excellent for sugarcane.",
                  "water stress and sandy soils severely limit sugarcane yields."),
}
IRRIGATION_DEPENDENCE = {  # irrigation type: (risk multiplier, description)
    "rain-fed": (1.5, "High dependence on monsoon patterns. Vulnerable to drought risk."),
    "canal irrigation": (0.8, "Stable water supply through canals. May have salinity risks if overused."),
    "borewell": (1.1, "Moderate risk depending on groundwater table levels."),
    "drip irrigation": (0.5, "Highly efficient water use, low water stress risk."),
}
DISTRICT_PROFILES = {  # district: zone, rainfall zone, drought, humidity, irrigation, salinity, flood, tendencies
    "Thanjavur": ("delta_region", "high_rainfall", "low", "humid_coastal", "canal_irrigation", "high", "high",
                  ["rice", "sugarcane", "banana"]),
    "Coimbatore": ("semi_arid", "low_rainfall", "high", "dry", "borewell", "low", "low",
                   ["cotton", "maize", "groundnut"]),
}
ZONE_MODIFIERS = {  # zone: (bonus crops, penalty crops)
    "delta_region": (["rice", "sugarcane"], ["wheat", "cotton"]),
    "semi_arid": (["cotton", "jowar", "maize"], ["rice", "banana"]),
}
SPATIAL_TEXT = {
    "wet_risk": "Flood sensitivity and potential salinity concerns.",
    "wet_context": "High humidity + strong monsoon compatibility.",
    "dry_risk": "Drought risk and water stress observations.",
    "dry_context": "Dry conditions require efficient water management.",
    "district_drought": "District has HIGH drought sensitivity. Water conservation crucial.",
    "district_flood": "District has HIGH flood sensitivity. Ensure proper drainage.",
    "district_salinity": "Coastal/Irrigated salinity risk present.",
    "zone_bonus": "District agro-climatic zone ({zone}) strongly favors this crop.",
    "zone_penalty": "District agro-climatic zone ({zone}) limits yield potential for this crop.",
}
WET_ZONES = ["coastal", "delta_region"]
DRY_ZONES = ["arid", "semi_arid", "dry_plains"]
STATE_ZONES = {  # state: macro region
    "Tamil Nadu": "southern_india", "Karnataka": "southern_india", "Kerala": "southern_india",
    "Andhra Pradesh": "southern_india", "Punjab": "northern_plains", "Haryana": "northern_plains",
    "Uttar Pradesh": "northern_plains", "Maharashtra": "western_india", "Gujarat": "western_india",
    "West Bengal": "eastern_india", "Odisha": "eastern_india", "Bihar": "eastern_india",
}

# ---------------------------------------------------------------------------
# FIXED VALUES - knowledge graph crop nodes
# crop: humidity, soils, sensitivities, demand N/P/K, irrigation, zones, sustainability,
#       sustainability factors, nitrogen fixer, water intensity
# ---------------------------------------------------------------------------
GRAPH_NODES = [
    ("rice", "high", ["clay", "loamy", "black soil"], ["drought", "water_stress"], ("high", "medium", "medium"),
     ["canal irrigation", "borewell"], ["Coastal", "Delta"], 75,
     ["High water footprint", "Methane emissions risk if flooded continuously"], False, "extreme"),
    ("maize", "medium", ["loamy", "black soil", "red soil"], ["frost", "waterlogging"], ("high", "medium", "high"),
     ["borewell", "drip irrigation", "canal irrigation"], ["Semi-Arid", "Dry Plains"], 82,
     ["High nutrient demand", "Supports crop rotation nicely"], False, None),
    ("cotton", "medium", ["black soil", "clay"], ["frost", "heavy_rain", "flood_sensitivity"], ("medium", "medium", "high"),
     ["borewell", "drip irrigation"], ["Semi-Arid", "Dry Plains"], 78,
     ["Deep taproot improves soil structure", "Highly pesticide dependent unless organic"], False, None),
    ("groundnut", "medium", ["sandy", "red soil", "loamy"], ["drought", "frost"], ("low", "high", "medium"),
     ["rain-fed", "drip irrigation"], ["Semi-Arid", "Dry Plains", "Coastal"], 96,
     ["Leguminous nitrogen-fixer", "Improves organic carbon, highly sustainable"], True, None),
    ("sugarcane", "high", ["clay", "black soil", "loamy"], ["frost", "drought"], ("high", "high", "high"),
     ["canal irrigation", "borewell"], ["Coastal", "Delta", "Western Ghats"], 65,
     ["Extremely high water and nutrient consumer", "Long duration exhausts soil profile"], False, "extreme"),
    ("banana", "high", ["clay", "loamy", "black soil"], ["drought", "high_winds"], ("high", "medium", "high"),
     ["borewell", "drip irrigation"], ["Coastal", "Delta", "Western Ghats"], 74,
     ["High potassium demands", "Requires structural windbreaks"], False, None),
    ("coconut", "high", ["sandy", "loamy", "red soil"], ["drought", "frost"], ("medium", "low", "high"),
     ["drip irrigation", "borewell"], ["Coastal", "Western Ghats"], 90,
     ["Perennial deep root holds coastal sand dunes", "Highly resilient once established"], False, None),
]
GRAPH_N_LOW, GRAPH_N_HIGH = 50.0, 120.0

# ---------------------------------------------------------------------------
# FIXED VALUES - recommendation lookups
# ---------------------------------------------------------------------------
FERTILIZER_BY_DEFICIENCY = {
    "Nitrogen deficient": "Apply Urea (46-0-0) or Ammonium Nitrate.",
    "Phosphorus deficient": "Apply Diammonium Phosphate (DAP) or Single Super Phosphate (SSP).",
    "Potassium deficient": "Apply Muriate of Potash (MOP) or Potassium Sulfate.",
    "Balanced": "Maintain current fertilizer schedule; soil nutrients are balanced.",
}
FERTILIZER_DEFAULT = "Consult local agronomic guidelines."
SEASON_CALENDAR = [  # (crop, season, advice)
    ("Rice", "kharif", "Sow June-July. Flood irrigation."),
    ("Rice", "rabi", "Rabi rice possible in TN - Pishanam/Samba varieties."),
    ("Rice", "summer", "Avoid summer rice - high water demand."),
    ("Wheat", "kharif", "Wheat is a Rabi crop - do not sow in Kharif."),
    ("Wheat", "rabi", "Sow Nov-Dec. Ideal for North India."),
    ("Wheat", "summer", "Not suitable."),
    ("Groundnut", "kharif", "Best season. Sow June-July in TN."),
    ("Groundnut", "rabi", "Second-best. Oct-Nov sowing."),
    ("Groundnut", "summer", "Possible with irrigation in Feb-Mar."),
    ("Sugarcane", "kharif", "Ratoon crop management."),
    ("Sugarcane", "rabi", "Plant cane Feb-Mar for optimal sucrose."),
    ("Sugarcane", "summer", "High water needs - ensure irrigation."),
    ("Banana", "kharif", "Transplant June-July. Common in TN."),
    ("Banana", "rabi", "Delayed growth - protect from cold."),
    ("Banana", "summer", "Risk of drought stress - drip irrigation essential."),
]
CROP_GUIDES = {
    "Rice": "Maintain 5-10 cm standing water. Ideal temp 22-30C. Watch for blast disease.",
    "Wheat": "Well-drained loamy soil. Sow Nov-Dec for Rabi. Ensure 6 irrigations.",
    "Sugarcane": "Deep black soil. High K for juice quality. Ratoon management key.",
    "Groundnut": "Sandy loam. Major crop in TN districts - Vellore, Tirunelveli.",
    "Cotton": "Deep black soil. Bt cotton common. Monitor bollworm carefully.",
    "Banana": "High moisture + warm climate. Prominent in Thanjavur, Trichy, TN.",
    "Coconut": "Sandy loam + coastal zones. Palakkad, Coimbatore districts. Salt tolerant.",
    "Maize": "Versatile crop. Kharif + Rabi. Well-drained loamy soil.",
    "Jowar": "Drought-tolerant. Rabi crop. Good for semi-arid TN zones.",
    "Ragi": "Rainfed crop. Excellent for hilly TN regions - Nilgiris, Salem.",
}
CROP_GUIDE_DEFAULT = "Consult local Krishi Vigyan Kendra (KVK) for guidance."

# ---------------------------------------------------------------------------
# FIXED VALUES - weather
# ---------------------------------------------------------------------------
WEATHER_CODES = [
    (0, "Clear sky"), (1, "Mainly clear"), (2, "Partly cloudy"), (3, "Overcast"),
    (45, "Fog"), (48, "Depositing rime fog"),
    (51, "Light drizzle"), (53, "Moderate drizzle"), (55, "Dense drizzle"),
    (61, "Slight rain"), (63, "Moderate rain"), (65, "Heavy rain"),
    (71, "Slight snow fall"), (73, "Moderate snow fall"), (75, "Heavy snow fall"),
    (77, "Snow grains"),
    (80, "Slight rain showers"), (81, "Moderate rain showers"), (82, "Violent rain showers"),
    (85, "Slight snow showers"), (86, "Heavy snow showers"),
    (95, "Thunderstorm"), (96, "Thunderstorm with slight hail"), (99, "Thunderstorm with heavy hail"),
]
WEATHER_TTL_SECONDS = 1800
TELEMETRY_DEFAULTS = {"N": 50.0, "P": 40.0, "K": 40.0, "temperature": 25.0, "humidity": 50.0, "rainfall": 100.0}
HISTORY_CAPACITY = 10
LATENCY_WINDOW = 100

# ---------------------------------------------------------------------------
# FIXED VALUES - decision-support narratives, actions and hybrid-score reasons
# ---------------------------------------------------------------------------
NARRATIVE_TEXT = {
    "ph_acidic": "Soil acidity is elevated (pH {ph}), which restricts optimal uptake of vital macronutrients like nitrogen and phosphorus.",
    "ph_alkaline": "Soil is moderately alkaline (pH {ph}), potentially binding iron and manganese, rendering them unavailable for crop root systems.",
    "ph_neutral": "Soil pH is balanced in the neutral optimal range (pH {ph}), facilitating efficient root bioavailability and nutrient transport.",
    "rain_ok": "Atmospheric inputs are exceptional: Rainfall of {rain} mm meets water-budget targets for {Crop}.",
    "rain_off": "Rainfall levels ({rain} mm) diverge from ideal targets ({lo}-{hi} mm) for water-sensitive {Crop}.",
    "hum_ok": "Relative humidity ({hum}%) matches {Crop}'s optimal transpiration requirements.",
    "generic": "Atmospheric and temperature factors are compatible with general agricultural practices.",
    "low_nutrients": "Chemical analysis highlights suboptimal levels of {low}, requiring strategic fertilizer top-offs to avoid nutrient deficiency stunted growth.",
    "rich_nutrients": "Macro-nutrient concentrations (N-P-K) are rich, providing excellent metabolic fuel for high-yield cycles.",
}
ACTION_TEXT = {
    "lime": "Apply agricultural lime (calcium carbonate) to buffer highly acidic soil (neutralize toxic aluminum/iron).",
    "sulfur": "Incorporate elemental sulfur or gypsum to reduce soil alkalinity and unlock bound micro-elements.",
    "humus": "Incorporate rich organic humus, compost, or animal manure to rebuild soil organic carbon (SOC) levels.",
    "nitrogen": "Apply fast-release Nitrogen fertilizer (e.g., Urea or Ammonium Sulfate) to correct severe foliage chlorosis.",
    "phosphorus": "Supplement soil with water-soluble Phosphate (e.g., Diammonium Phosphate - DAP or Triple Super Phosphate).",
    "potassium": "Distribute Muriate of Potash (MOP) or Potassium Sulfate to buffer drought and disease resistance.",
    "maintenance": "Execute standard N-P-K maintenance routine. Monitor micro-nutrient ratios.",
    "green_manure": "Integrate dynamic green manure cover crops (e.g., alfalfa) to naturally elevate nitrogen levels.",
    "aeration": "Introduce systematic soil aeration to promote friendly aerobic microbial colonies.",
    "drip": "Implement localized drip irrigation to regulate root zone hydration and prevent fertilizer washing/runoff.",
    "rotation": "Consider rotational pulse farming (e.g., chickpea/lentils) next cycle to naturally restore nitrogen reserves.",
    "cover": "Introduce cover cropping to protect soil top layers from summer wind erosion.",
    "routine": "Continue routine weekly soil telemetry scans. No critical soil correctors required.",
    "diagnostic": "Conduct a professional deep-core soil diagnostic before the next sowing season.",
}
ROTATION_CROPS = ["rice", "jute", "cotton"]
HYBRID_REASON_TEXT = {
    "conf_high": "High neural model prediction agreement elevated baseline certainty.",
    "conf_low": "Slight model variance in secondary crop candidates reduced confidence.",
    "ph_ok": "Perfect soil pH balance highly optimized nutrient solubility.",
    "ph_off": "Suboptimal soil pH slightly lowered general nutrient absorption efficiency.",
}
TIER_TEXT = {
    "critical": "WARNING: The ML model suggested {Pred}, but environmental physics show a CRITICAL MISMATCH (Suitability: {suit}%). We highly recommend sowing seasonal winter/Rabi crops instead.",
    "high": "{Pred} strongly matches both neural predictions and seasonal environment physics.",
    "moderate": "The field partially supports {pred} cultivation, but seasonal factors suggest some yield volatility.",
    "low": "Current field conditions are weakly aligned with {pred} cultivation. Exercise caution.",
}
