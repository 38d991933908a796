"""Fixed values of the incident domain.

Everything in this module is data: word lists, phrase patterns, thresholds and
names whose exact spelling and order decide the results.  A block lists one
category per line as ``Category: item; item; ...``; patterns are regular
expressions over lower-case text.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# thresholds
# ---------------------------------------------------------------------------
MIN_PATTERN_SUPPORT = 5
LOW_SAMPLE_SIZE = 10
LOW_PATTERN_SUPPORT = 10
EMERGING_THRESHOLD = 1.0
EMERGING_PERIOD = "quarter"
PRIORITY_WEIGHTS = {"frequency": 0.20, "sif_density": 0.35, "avg_sif_probability": 0.25, "cross_site": 0.20}
PRIORITY_LABEL = "Prototype Prioritization Score"
CROSS_SITE_MINIMUM = 2
PROFILE_TOP_K = 5
RETRIEVAL_TOP_K = 5
EXCERPT_LENGTH = 120
EXCERPT_COUNT = 3
EXAMPLE_COUNT = 5
SIF_DEFAULT_THRESHOLD = 0.5
SIF_MIN_RECALL = 0.85
SIF_THRESHOLD_GRID = [0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50,
                      0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90]
RULE_SCORE_THRESHOLD = 0.35
SEMANTIC_THRESHOLD = 0.65
NEGATION_WINDOW = 30
LONG_NEGATION_WINDOW = 60
FIRE_CONTEXT = 30
MIN_CLAUSE_LENGTH = 10
TFIDF_MAX_FEATURES = 5000
TFIDF_MIN_DF = 2
TFIDF_MAX_DF = 0.95
LOGISTIC_C = 1.0
LOGISTIC_MAX_ITER = 1000
EMBEDDING_BATCH = 64
EMBEDDING_DIMENSION = 384
READINESS_F1 = {"activity": 0.70, "equipment_type": 0.70, "hazard": 0.60, "barrier_failure": 0.70}
ANALYTICS_VERSION = "0.5.0"

# Defaults for missing report fields
PROCESSOR_DEFAULTS = {"site": "General Site", "location": "Unspecified Location", "report_type": "Incident"}
UPLOAD_DEFAULTS = {"site": "Unknown", "location": "Unknown", "report_type": "Unspecified"}

# Cells a CSV reader treats as missing
CSV_NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                   "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# columns
REQUIRED_ENRICHED_COLUMNS = ["report_id", "sif_prediction", "sif_probability", "predicted_activity", "predicted_lsr"]
REQUIRED_RAW_COLUMNS = ["report_id", "date", "site", "location", "report_type", "activity", "description",
                        "sif_label", "sif_potential", "primary_lsr", "lsr_tags", "hazard", "barrier_failure",
                        "equipment", "potential_consequence", "actual_consequence", "precursor_tags", "severity"]
FORBIDDEN_FEATURE_COLUMNS = ["sif_label", "sif_potential", "primary_lsr", "lsr_tags", "hazard", "barrier_failure",
                             "potential_consequence", "actual_consequence", "severity", "precursor_tags"]
LIST_COLUMNS = ["predicted_activity", "predicted_equipment", "predicted_hazards", "predicted_barrier_failures",
                "predicted_precursor_tags", "predicted_potential_consequences", "predicted_lsr"]

# Recurring pattern definitions (type, columns)
PAIR_PATTERNS = [
    ("activity_barrier", ["predicted_activity", "predicted_barrier_failures"]),
    ("activity_hazard", ["predicted_activity", "predicted_hazards"]),
    ("activity_lsr", ["predicted_activity", "predicted_lsr"]),
    ("site_lsr", ["site", "predicted_lsr"]),
    ("site_barrier", ["site", "predicted_barrier_failures"]),
    ("site_hazard", ["site", "predicted_hazards"]),
    ("hazard_barrier", ["predicted_hazards", "predicted_barrier_failures"]),
    ("location_precursor", ["location", "predicted_precursor_tags"]),
    ("lsr_barrier", ["predicted_lsr", "predicted_barrier_failures"]),
]
TRIPLE_PATTERNS = [
    ("activity_hazard_barrier", ["predicted_activity", "predicted_hazards", "predicted_barrier_failures"]),
]
EMERGING_STATUS_ORDER = ["EMERGING", "NEW_PATTERN", "INCREASING", "STABLE", "DECREASING"]

# ---------------------------------------------------------------------------
# The nine rules
# ---------------------------------------------------------------------------
LIFE_SAVING_RULES = ["Bypassing Safety Controls", "Confined Space", "Driving", "Energy Isolation", "Hot Work",
                     "Line of Fire", "Safe Mechanical Lifting", "Work at Height", "Work Authorization"]

# Abbreviation expansions, applied in this order
ABBREVIATIONS = """
loto: lockout tagout
ptw: permit to work
jsa: job safety analysis
simops: simultaneous operations
ip: injured person
ppe: personal protective equipment
hsse: health safety security environment
toolbox talk: tbt
h2s: hydrogen sulfide
uoc: unsafe condition
uoa: unsafe act
nm: near miss
pip: process incident
pof: probability of failure
"""

# ---------------------------------------------------------------------------
# Extraction patterns (regular expressions over lower-case text)
# ---------------------------------------------------------------------------
ACTIVITY_RULES = r"""
Maintenance: maintenance; repair(?:ing)?; servic(?:ing|e); replac(?:ing|e); work(?:ing)? on; inspect(?:ing|ion)?; overhaul; corrective maintenance; troubleshooting
Drilling: drill(?:ing)?
Pressure Testing: pressure test(?:ing)?; hydrotest(?:ing)?; pneumatic test; leak test
Welding: weld(?:ing|er)?; torch cutting; gas cutting; flame cutting; grinding; soldering
Hot Work: hot\s*work; spark(?:s)?
Electrical Work: electrical work; wiring; electrician; electrical maintenance; panel maintenance; cable work; breaker maintenance
Confined Space Entry: confined[- ]space; enter(?:ing|ed)?.*vessel; enter(?:ing|ed)?.*tank; vessel entry; tank entry; manhole entry; vessel inspection; tank cleaning; sump maintenance
Mechanical Lifting: lift(?:ing)?; hoist(?:ing)?; rigging; load movement; crane operation; forklift operation
Crane Operation: crane
Vehicle Movement: driv(?:ing|e); vehicle; truck; reversing; transport; forklift movement; transporting personnel; material delivery; site patrol; heavy haulage
Excavation: excavat(?:ing|ion)?; digging; trench(?:ing)?
Working at Height: height; scaffold(?:ing)?; roof; elevated; ladder work; platform
Chemical Handling: chemical; toxic
Loading/Unloading: load(?:ing)?; unload(?:ing)?
Equipment Cleaning: clean(?:ing)?
Operations: valve operation; process operation; alarm testing; non-routine task
Contractor Work: contractor work; contractor
Pipefitting: pipefitting; pipework
Painting: paint(?:ing)?
Torquing: torquing; torque
"""

UNSAFE_ACTION_RULES = r"""
Entering danger zone: stepped into.*danger zone; entered exclusion zone; walked below.*load; stood.*load; stood under.*load; stood below.*suspended; entered.*swing radius
Opening pressurized equipment: cracked open.*flange; opening pressurized; opened.*before.*depressurized
Bypassing interlock: bypassed.*interlock; disabled.*alarm
Working without permit: working without.*permit; permit.*expired; started.*without.*permit
Starting hot work without valid gas test: cutting.*after.*gas test.*expired; hot work.*without.*gas test
Driving without seatbelt: without seatbelt
Working at height without fall protection: without.*fall protection; without connecting.*harness; not tied off
Entering confined space without authorization: entered.*without.*confined-space permit
"""

UNSAFE_CONDITION_RULES = r"""
Pressurized line: line remained pressurized; pressurized line
Suspended load present: suspended load was positioned; load was suspended
Missing barricade: missing barricade; no barricade
Exposed electrical conductor: exposed.*electrical; exposed wiring
Combustible material near hot work: combustible.*near hot work; flammable.*near hot work
Unstable scaffold: unstable scaffold; scaffold.*unstable
Poor ventilation: poor ventilation; inadequate ventilation
Leaking hydrocarbon line: leaking hydrocarbon; hydrocarbon leak
Defective guard: defective guard; missing guard
Unprotected opening: unprotected opening; open hole
"""

# Barrier phrases; BARRIER_PHRASES alone serves the phrase-to-category lookup,
# BARRIER_EXTENSIONS are the further patterns used on report text.
BARRIER_PHRASES = """
ENERGY_ISOLATION_FAILURE: loto missing; lock-out not performed; isolation was not verified; loto not applied; isolation valve leaking; bleed valve closed; padlock missing; energy not verified zero
WORK_AUTHORIZATION_FAILURE: ptw not issued; jsa not discussed; wrong permit type; expired permit; permit missing; unauthorized
GAS_TEST_FAILURE: gas test not performed; gas test expired; no gas check
FALL_PROTECTION_FAILURE: harness not clipped; scaffold tag missing; lanyard defective; missing toe boards; not tied off
LIFTING_CONTROL_FAILURE: overloaded crane; damaged slings used; outriggers not extended; no tag lines used; lift plan not followed
LINE_OF_FIRE_CONTROL_FAILURE: standing in pinch point; exclusion zone breached; tension line snapped; in the line of fire
TRAFFIC_CONTROL_FAILURE: speeding; seatbelt not worn; using mobile phone; fatigued driver; brakes defective
SAFETY_DEVICE_BYPASS: interlock bridged; alarm disabled; safety valve isolated; override left active
BARRICADING_FAILURE: no barricade below; barricades ignored
COMMUNICATION_FAILURE: attendant absent; fire watcher absent
PPE_FAILURE: missing ppe; safety glasses not worn
PROCEDURE_NON_COMPLIANCE: procedure not followed
"""

BARRIER_EXTENSIONS = r"""
ENERGY_ISOLATION_FAILURE: loto was not applied; equipment wasn't isolated; before loto was applied; without loto; line not proven dead; isolation not verified; lockout not applied; residual pressure remained; failed to isolate
WORK_AUTHORIZATION_FAILURE: without a valid.*permit; without.*authorization; without.*permit; permit.*expired; no valid permit; permit not issued; unauthorized work
GAS_TEST_FAILURE: gas test.*expired; no atmospheric testing; atmosphere not tested; gas reading validity expired
FALL_PROTECTION_FAILURE: without connecting.*harness; harness not connected; no lifeline; lanyard unclipped; fall arrest missing
LIFTING_CONTROL_FAILURE: defective sling; rigging failure; tag line missing; lifting zone not controlled; overloaded crane
LINE_OF_FIRE_CONTROL_FAILURE: worker in danger zone; personnel in swing radius; pinch point exposure
SAFETY_DEVICE_BYPASS: bypassed.*interlock
"""

# Literal hazard phrases
HAZARD_PHRASES = """
Stored energy: stored energy; tensioned line; spring; line had not been proven dead; residual pressure; energized; trapped pressure; line remained live; still energized; pressure remained; depressurization incomplete; unexpected startup; whip from parted cable
Pressurized equipment: pressurized; not depressurized; pressure hose failed; hose failed; hose snapped; high pressure release; overpressure
Loss of containment: weeping; fluid leak; line leak; spill; loss of containment; hose burst; flange leak; seal leaking; pipe leaking; liquid escaping; fluid escaping; spray; discharge; release; hose snapped; steam leak
Hydrocarbon release: hydrocarbon release; oil leak; gas leak; hydrocarbon leaking; hydrocarbon leaked
Fire/explosion: fire; explosion; combustible; flash fire; burning; ignited
Flammable atmosphere: flammable atmosphere
Toxic gas: toxic gas; toxic fumes
H2S exposure: h2s; h2s detected; hydrogen sulfide; sour gas
Electrical energy: electrical; live wire; electrical shock; electrocution
Suspended load: suspended load; dropped suspended load; swinging load; rigging failure; dropped load; crane tip-over
Dropped object: dropped object; fell from
Line-of-fire exposure: line of fire; danger zone; pinch point; swing radius; caught between objects; caught in pinch point; struck by moving object
Vehicle interaction: vehicle collision; rollover; loss of control; pedestrian impact; struck by vehicle; vehicle incident
Moving machinery: moving machinery; rotating machinery; entanglement
Confined atmosphere: confined space; confined-space; vessel entry; poor ventilation; oxygen deficiency; engulfment
Chemical exposure: chemical spill; acid leak; caustic exposure; chemical exposure
Fall from height: fall from height; falling from; open grating; unprotected edge; fall hazard
Unidentified hazards: unidentified hazards; simultaneous operations clash; uncontrolled work
"""

# Guards, contexts and negation words for hazards
HAZARD_GUARDS = """
Fire/explosion: ignition; combustible; fire; explosion; flame; burn; ignited
H2S exposure: h2s; hydrogen sulfide; sour gas
Hydrocarbon release: hydrocarbon; oil; gas; fuel
"""
FIRE_EXCLUDED_CONTEXTS = ["line of fire", "fire gas panel", "fire & gas", "fire extinguisher"]
NEGATORS = ["no", "not", "without", "failed to", "didn't", "did not", "wasn't", "was not"]
LINE_OF_FIRE_CLEAR = ["out of the", "out of", "remained clear", "stayed clear", "nobody was in the"]
ENERGY_CLEAR = ["zero energy", "fully depressurize", "not pressurized"]
ENERGY_CATEGORIES = ["Stored energy", "Pressurized equipment"]

# Meaning texts for the semantic fallback, and its keyword restrictions
HAZARD_MEANINGS = """
Pressurized equipment: pressure trapped in a hose, vessel, or piping system that has not been bled down or depressurized.
Stored energy: mechanical, electrical, or pneumatic energy remaining in equipment that is not properly locked out or isolated.
Loss of Containment: fluid, gas, or liquid started weeping, leaking, or spilling from a flange, hose, line, or vessel.
Suspended load: heavy object being lifted or hoisted by a crane, placing personnel at risk of crushing.
Line-of-fire exposure: personnel positioned in a danger zone, swing radius, or pinch point where they could be struck by moving objects.
Fall from height: working on an elevated platform, scaffold, roof, or ladder with potential to fall.
"""
MEANING_RESTRICTIONS = """
Fire/explosion: ignition; fire; explosion; flame; burn
Fall from height: height; fall; scaffold; ladder; roof; platform; elevat
Suspended load: load; lift; hoist; crane; swing; suspend
"""

# Consequences inferred from hazards
HAZARD_CONSEQUENCES = """
Pressurized equipment: Major Process Safety Event
Loss of containment: Major Process Safety Event
Fire/explosion: Fire Injury; Explosion Injury; Major Process Safety Event
H2S exposure: Toxic Exposure; Loss of Consciousness; Fatal Exposure
Chemical exposure: Toxic Exposure
Fall from height: Fall Injury; Fatal Fall
Electrical energy: Electrical Injury
Suspended load: Crushing Injury; Struck-By Injury
Vehicle interaction: Vehicle / Pedestrian Injury
"""

# Precursor tags; a hazard or condition counts when it contains the left text,
# a barrier failure when it equals it.
HAZARD_TAGS = """
stored energy: stored-energy
pressurized: pressurized-system
line-of-fire: line-of-fire
suspended load: suspended-load
vehicle: vehicle-interaction
"""
BARRIER_TAGS = """
ENERGY_ISOLATION_FAILURE: missing-loto
WORK_AUTHORIZATION_FAILURE: expired-permit
GAS_TEST_FAILURE: gas-test-failure
FALL_PROTECTION_FAILURE: fall-protection
SAFETY_DEVICE_BYPASS: bypassed-interlock
BARRICADING_FAILURE: missing-barricade
COMMUNICATION_FAILURE: communication-failure
"""
CONDITION_TAGS = """
confined space: confined-space-control
"""

# Equipment words, and tagged equipment such as "Pump P-204" or "P-204 pump"
TAGGED_EQUIPMENT = ["pump", "compressor", "valve", "tank", "vessel", "spool", "crane", "truck", "panel", "system",
                    "block", "reactor", "winch", "separator", "heat exchanger"]
EQUIPMENT_WORDS = ["pump", "compressor", "valve", "tank", "vessel", "boiler", "sump", "reactor", "separator",
                   "heat exchanger", "pipeline", "flange", "crane", "forklift", "drill pipe", "pipe spool",
                   "pipe rack", "welding machine", "scaffold", "ladder", "electrical panel", "mcc panel",
                   "dcs system", "pressure vessel", "rigging", "lifting sling", "shackle", "gantry",
                   "chain block", "winch", "torque wrench", "pressure hose", "hose", "angle grinder", "torch",
                   "cherry picker", "excavator", "crew bus", "light vehicle", "workshop", "utility area",
                   "camp facility", "process module", "grating", "walkway"]
# Type of an equipment mention, first line with a contained word wins
EQUIPMENT_TYPES = """
Pump: pump
Compressor: compressor
Valve: valve
Tank: tank
Vessel: vessel; boiler; sump; reactor; separator; heat exchanger
Pipeline: pipeline; line; spool
Crane: crane; winch; gantry; chain block
Forklift: forklift
Scaffold: scaffold
Ladder: ladder
Hose: hose
Torque Wrench: wrench
Grinder: grinder
Torch: torch
Vehicle: truck; vehicle; bus; cherry picker; excavator
Electrical Panel: panel; dcs
Facility: workshop; area; camp; module
Structure: rack; grating
"""

# ---------------------------------------------------------------------------
# Canonical names and their variants
# ---------------------------------------------------------------------------
ACTIVITY_NAMES = """
Maintenance: repair; servicing; inspection; overhaul; maintenance; corrective maintenance; fix; replace; pump overhaul; electrical troubleshooting; filter replacement; system maintenance; general maintenance
Hot Work: welding; weld; torch cutting; gas cutting; grinding; flame cutting; hot work; soldering
Mechanical Lifting: lifting; hoist; rigging; crane; load movement; forklift operation
Working at Height: scaffold; elevated platform; ladder; roof; height
Confined Space Entry: vessel entry; tank entry; confined space; entering vessel; manhole; vessel inspection; tank cleaning; internal repair; sump maintenance
Electrical Work: electrical; panel; cable; breaker; wiring
Pressure Testing: hydrotest; pressure test; pneumatic test; leak test
Vehicle Movement: driving; reversing; vehicle; transport; forklift; truck; transporting personnel; material delivery; site patrol; heavy haulage
Excavation: excavat; digging; trench
Loading/Unloading: load; unload
Cleaning: clean; wash
Operations: valve operation; process operation; alarm testing; non-routine task; manual handling
Contractor Work: contractor work
Pipefitting: pipefitting
Painting: painting
Torquing: torquing
"""

HAZARD_NAMES = """
Stored Energy: stored energy; tensioned line; spring; unexpected startup; release of stored energy; whip from parted cable
Pressurized Equipment: pressurized; pressure; hose; flange; high pressure release; overpressure
Loss of Containment: weeping; fluid leak; line leak; spill; loss of containment; steam leak
Hydrocarbon Release: hydrocarbon; oil leak; gas leak
Fire/Explosion: fire; explosion; combustible
Flammable Atmosphere: flammable; gas test
Toxic Gas: toxic gas; toxic fumes
H2S Exposure: h2s; hydrogen sulfide
Electrical Energy: electrical; live wire; panel
Suspended Load: suspended load; crane; hoist; lifting; dropped suspended load; swinging load; crane tip-over; rigging failure
Dropped Object: dropped object; fell from
Line-of-Fire Exposure: line of fire; danger zone; pinch point; swing radius; struck by moving object; caught in pinch point; caught between objects
Vehicle Interaction: vehicle; truck; forklift; pedestrian impact; struck by vehicle; vehicle collision; rollover; loss of control
Moving Machinery: moving machinery; rotating
Confined Atmosphere: confined space; vessel entry; poor ventilation; confined atmosphere; oxygen deficiency; engulfment
Chemical Exposure: chemical; acid; caustic
Fall from Height: height; fall; scaffold; ladder; roof; platform; open grating
Unidentified Hazards: unidentified hazards; simultaneous operations clash; uncontrolled work
"""

BARRIER_NAMES = """
ENERGY_ISOLATION_FAILURE: loto missing; isolation not verified; loto not applied; line not proven dead; lockout not applied; residual pressure; line still energized; failed to isolate
WORK_AUTHORIZATION_FAILURE: permit expired; no valid permit; permit not issued; unauthorized; ptw not issued; jsa not discussed; permit missing; wrong permit type
GAS_TEST_FAILURE: gas test expired; no atmospheric testing; atmosphere not tested; gas reading validity expired; gas test not performed; no gas check
FALL_PROTECTION_FAILURE: harness not connected; no lifeline; lanyard unclipped; fall arrest missing; harness not clipped; not tied off; scaffold tag missing; missing toe boards
LIFTING_CONTROL_FAILURE: overloaded crane; defective sling; rigging failure; tag line missing; lifting zone not controlled; damaged slings used; outriggers not extended; lift plan not followed; no tag lines used
LINE_OF_FIRE_CONTROL_FAILURE: worker in danger zone; stood below load; personnel in swing radius; pinch point exposure; exclusion zone breached; tension line snapped; in the line of fire; standing in pinch point
TRAFFIC_CONTROL_FAILURE: speeding; seatbelt not worn; using mobile phone; fatigued driver; brakes defective
SAFETY_DEVICE_BYPASS: interlock bridged; alarm disabled; safety valve isolated; override left active; bypassed interlock
BARRICADING_FAILURE: no barricade below; barricades ignored; missing barricade; area not barricaded
COMMUNICATION_FAILURE: attendant absent; fire watcher absent
PPE_FAILURE: missing ppe; safety glasses not worn
PROCEDURE_NON_COMPLIANCE: procedure not followed; combustibles not cleared; sparks falling
"""

EQUIPMENT_NAMES = """
Pump: pump
Compressor: compressor
Valve: valve
Tank: tank
Vessel: vessel; boiler; sump
Pipeline: pipeline; line; spool
Flange: flange
Crane: crane; winch; gantry; chain block
Forklift: forklift
Drill Pipe: drill pipe; drill
Welding Machine: welding machine; welder
Scaffold: scaffold; scaffolding
Ladder: ladder
Electrical Panel: electrical panel; panel; mcc panel; dcs system; fire & gas panel; switchgear
Pressure Vessel: pressure vessel
Rigging: rigging; sling; shackle; pallet
Hose: hose; pressure hose
Torque Wrench: torque wrench; wrench
Grinder: grinder
Torch: torch
Vehicle: truck; bus; vehicle; car
Facility: process module; workshop; utility area; camp facility
Structure: pipe rack; grating; walkway
"""

TAG_NAMES = """
stored-energy: stored-energy; stored energy; energy isolation; pressure
pressurized-system: pressurized-system; pressure
missing-loto: missing-loto; loto
line-of-fire: line-of-fire; danger zone; swing radius
expired-permit: expired-permit; permit; work authorization
gas-test-failure: gas-test-failure; gas test
fall-protection: fall-protection; height; harness
suspended-load: suspended-load; lifting; crane
bypassed-interlock: bypassed-interlock; interlock; bypass
missing-barricade: missing-barricade; barricade
vehicle-interaction: vehicle-interaction; vehicle; traffic
confined-space-control: confined-space-control; confined space
communication-failure: communication-failure; communication
"""

CONSEQUENCE_NAMES = """
Serious Burns: severe burns; fatal burns; burn
Electrical Injury: electric shock; shock
Fatal Electrical Injury: electrocution; fatal shock
Asphyxiation: asphyxiation; suffocation
Toxic Exposure: toxic gas exposure; toxic exposure; fumes
Crushing Injury: crushed by load; crush fatality; crush injury; crushing
Struck-By Injury: struck by; impact injury
Fall Injury: fall injury; fall
Fatal Fall: fatal fall; fell to death
Vehicle / Pedestrian Injury: pedestrian impact; run over; vehicular injury
Major Equipment Damage: equipment destruction; structural collapse; equipment damage
Fire Injury: fire injury
Explosion Injury: explosion injury
Major Process Safety Event: process safety event; catastrophic release; facility explosion
Loss of Consciousness: loss of consciousness; passed out
Fatal Exposure: fatal exposure; fatality
"""

# Hazard texts that are really consequences, and the token they become
IGNORE_TOKEN = "CONSEQUENCE_IGNORE"
CONSEQUENCES_AMONG_HAZARDS = [
    "severe burns", "electric shock", "electrocution", "asphyxiation", "crushed by load",
    "pedestrian impact", "equipment destruction", "process safety event", "toxic gas exposure",
    "toxic fumes", "fatality", "crush fatality", "fatal burns", "major explosion",
    "catastrophic release", "multiple fatalities", "serious injury due to lack of hazard awareness",
    "process incident", "fatal traffic accident", "severe whiplash", "crush injuries to pedestrian",
    "structural collapse", "multiple serious injuries", "major fire", "facility explosion",
]


def table(block: str) -> list[tuple[str, list[str]]]:
    """``Category: item; item`` lines as (category, items), in order."""
    rows = []
    for line in block.strip().splitlines():
        category, items = line.split(": ", 1)
        rows.append((category, [item.strip() for item in items.split(";")]))
    return rows


def pairs(block: str) -> list[tuple[str, str]]:
    """``Category: text`` lines as (category, text), in order."""
    return [tuple(line.split(": ", 1)) for line in block.strip().splitlines()]
