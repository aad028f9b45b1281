"""Word lists, tables and patterns that results depend on. Order breaks ties."""

from __future__ import annotations

# Words that vote for a document's category
CATEGORY_KEYWORDS = {
    "cement": [
        "portland cement", "ordinary portland", "pozzolana cement", "slag cement", "rapid hardening", "white cement", "masonry cement",
        "supersulphated", "sulphate resisting", "high alumina", "aluminous", "hydrophobic cement", "low heat cement", "cement composition",
        "fineness", "soundness", "setting time", "compressive strength cement", "cement specification", "cement requirements",
        "cement chemical",
    ],
    "aggregate": [
        "coarse aggregate", "fine aggregate", "natural aggregate", "crushed stone", "gravel", "aggregate grading", "sand",
        "particle size distribution", "sieve analysis", "aggregate testing", "aggregate soundness", "aggregate crushing", "flakiness index",
    ],
    "concrete": [
        "reinforced concrete", "prestressed concrete", "plain concrete", "structural concrete", "mass concrete", "concrete specification",
        "concrete strength", "concrete workability",
    ],
    "pipe": [
        "concrete pipe", "precast pipe", "reinforced pipe", "pressure pipe", "water main", "sewer pipe", "culvert", "drainage pipe",
        "prestressed pipe", "asbestos cement pipe", "pipe specification", "pipe testing", "hydrostatic pressure",
    ],
    "block": [
        "concrete block", "masonry block", "hollow block", "solid block", "concrete masonry unit", "lightweight block", "aerated concrete",
        "autoclaved aerated", "load bearing block", "partition block", "block specification", "masonry unit",
    ],
    "sheet": [
        "corrugated sheet", "roofing sheet", "asbestos cement sheet", "cladding", "semi-corrugated", "roofing and cladding",
        "sheet specification", "roofing material",
    ],
    "brick": [
        "burnt clay brick", "common brick", "building brick", "fly ash brick", "lime brick", "brick specification", "brick testing",
        "brick strength",
    ],
    "mortar": ["masonry mortar", "sand for mortar", "lime mortar", "mortar specification", "mortar mix", "mortar strength"],
}

# Technical terms by category
TECHNICAL_TERMS = {
    "cement": [
        "composition", "fineness", "soundness", "setting time", "compressive strength", "tensile strength", "chemical requirements",
        "physical requirements", "specific gravity", "blaine", "autoclave", "le chatelier", "vicat", "gillmore", "consistency", "expansion",
    ],
    "aggregate": [
        "grading", "particle size", "sieve analysis", "moisture content", "water absorption", "specific gravity", "bulk density",
        "soundness", "abrasion", "crushing value", "impact value", "flakiness index", "elongation index", "deleterious materials",
    ],
    "concrete": [
        "workability", "slump", "compaction factor", "cube strength", "cylinder strength", "modulus of elasticity", "durability",
        "permeability", "water cement ratio",
    ],
    "pipe": [
        "internal diameter", "wall thickness", "hydrostatic pressure", "crushing strength", "absorption", "reinforcement", "joints",
        "impermeability", "three edge bearing",
    ],
    "block": [
        "compressive strength", "water absorption", "density", "dimensions", "drying shrinkage", "moisture movement",
        "load bearing capacity",
    ],
    "sheet": ["thickness", "width", "length", "corrugation", "pitch", "weathering", "transverse strength", "impact resistance"],
}

# Nouns added to the keywords of any document
DOMAIN_NOUNS = [
    "specification", "requirements", "testing", "test method", "chemical", "physical", "mechanical", "properties", "composition",
    "standard", "grade", "type", "class", "manufacture", "quality", "sampling", "procedure",
]

# Property terms by kind
TECHNICAL_PROPERTIES = {
    "physical": [
        "compressive strength", "tensile strength", "flexural strength", "modulus of elasticity", "density", "bulk density",
        "specific gravity", "fineness", "surface area", "blaine fineness", "particle size", "water absorption", "moisture content",
        "permeability", "dimensional stability", "shrinkage", "expansion", "soundness", "setting time", "initial setting", "final setting",
        "consistency", "workability", "slump", "flow", "compaction factor",
    ],
    "chemical": [
        "chemical composition", "loss on ignition", "insoluble residue", "magnesia content", "sulphuric anhydride", "chloride content",
        "alkali content", "lime saturation factor", "alumina modulus", "silica modulus", "iron modulus", "free lime",
        "tricalcium aluminate", "tricalcium silicate", "dicalcium silicate", "ph value",
    ],
    "testing": [
        "test method", "sampling procedure", "specimen preparation", "sieve analysis", "grading", "gradation", "particle size distribution",
        "crushing value", "impact value", "abrasion value", "soundness test", "autoclave expansion", "le chatelier test", "vicat apparatus",
        "gillmore needle", "compressive testing", "tensile testing", "hydrostatic pressure test", "impermeability test",
    ],
    "manufacturing": [
        "manufacture", "production", "processing", "composition", "raw materials", "clinker", "gypsum", "grinding", "blending",
        "calcination", "hydration", "curing", "autoclaving", "steam curing", "air curing", "maturity", "age",
    ],
    "quality": [
        "specification", "requirements", "tolerance", "acceptance criteria", "conformity", "compliance", "quality control",
        "quality assurance", "inspection", "certification", "marking", "packaging", "storage",
    ],
}

# Terms of fields of use
APPLICATION_DOMAINS = {
    "structural_concrete": [
        "structural concrete", "reinforced concrete", "load bearing", "beam", "column", "slab", "foundation", "footing", "retaining wall",
    ],
    "mass_concrete": ["mass concrete", "dam", "large volume", "low heat", "thermal cracking"],
    "marine_coastal": ["marine", "coastal", "aggressive water", "seawater", "tidal", "offshore", "sulphate attack", "chloride environment"],
    "road_pavement": ["road", "pavement", "highway", "runway", "rigid pavement"],
    "building_construction": [
        "building", "residential", "commercial", "housing", "superstructure", "wall", "partition", "flooring", "roofing", "cladding",
    ],
    "precast_products": ["precast", "prefabricated", "factory made", "modular", "ready-made"],
    "masonry_work": ["masonry", "brickwork", "blockwork", "stone masonry", "mortar", "jointing", "plastering", "rendering"],
    "water_infrastructure": [
        "water supply", "water main", "pipeline", "drainage", "sewerage", "sewer", "culvert", "irrigation", "water tank", "reservoir",
    ],
    "architectural_decorative": ["architectural", "decorative", "aesthetic", "finish", "facade", "white cement", "colored", "textured"],
    "special_applications": [
        "refractory", "high temperature", "furnace", "kiln", "chemical resistant", "acid resistant", "abrasion resistant", "waterproofing",
        "insulation",
    ],
}

# materials
COMPOSITION_TERMS = [
    "portland cement", "clinker", "gypsum", "pozzolana", "fly ash", "ground granulated blast furnace slag", "ggbs", "slag", "calcined clay",
    "silica fume", "metakaolin", "fine aggregate", "sand", "coarse aggregate", "gravel", "crushed stone", "lightweight aggregate",
    "expanded clay", "pumice", "vermiculite", "admixture", "plasticizer", "superplasticizer", "retarder", "accelerator",
    "air entraining agent", "waterproofing compound", "steel reinforcement", "rebar", "wire", "mesh", "fiber", "prestressing steel",
    "high tensile wire", "asbestos fiber", "cellulose fiber", "polypropylene fiber", "calcium aluminate", "alumina cement", "lime",
    "hydrated lime", "calcium hydroxide", "calcium carbonate", "dolomite",
]

# Phrases of test-method documents
TEST_METHOD_INDICATORS = [
    "test method", "method of test", "determination of", "testing of", "sampling of", "procedure for", "measurement of", "analysis of",
    "specification for tests", "methods of sampling",
]

# Numbers of test-method standards
TEST_METHOD_STANDARDS = [
    "4031", "4032", "1727", "3812", "3535", "8142", "8143", "2386", "1199", "1124", "5512", "5514", "6441",
]

# Words that search ignores
STOPWORDS = [
    "the", "is", "a", "an", "for", "of", "and", "in", "to", "with", "which", "that", "are", "be", "by", "on", "or", "as", "it", "at",
    "from", "this", "was", "were", "has", "have", "had", "been", "not", "but", "if", "its", "do", "does", "no", "up", "out", "so", "than",
    "can", "will", "more", "also", "such", "shall", "may", "when",
]

# Words that rationales ignore
RATIONALE_STOPWORDS = [
    "the", "is", "a", "an", "for", "of", "and", "in", "to", "with", "which", "that", "are", "be", "by", "on", "or", "as", "we", "our", "i",
    "need", "want", "looking", "what", "standard", "bis", "indian", "specification", "requirements", "comply", "regulations", "covers",
    "applicable", "official", "company", "manufacturing", "intended", "used", "use", "shall", "may", "not", "more", "less", "than",
]

# Words that the list of expanded terms ignores
TERM_STOPWORDS = [
    "the", "and", "for", "with", "from", "this", "that", "into", "your", "you", "are", "was", "were", "have", "has", "had", "will", "shall",
    "should", "would", "can", "could", "may", "might",
]

# Misspellings, replaced in this order
TYPO_FIXES = {
    "asbestous": "asbestos",
    "asbestus": "asbestos",
    "portand": "portland",
    "portlnd": "portland",
    "cememnt": "cement",
    "cment": "cement",
    "aggreagte": "aggregate",
    "aggregaet": "aggregate",
    "reinfored": "reinforced",
    "reinforcment": "reinforcement",
    "sulphte": "sulphate",
    "sulpahte": "sulphate",
    "pozzalana": "pozzolana",
    "pozzlana": "pozzolana",
}

# Abbreviations, as whole words
ABBREVIATIONS = {
    "opc": "ordinary portland cement",
    "ppc": "portland pozzolana cement",
    "psc": "portland slag cement",
    "hac": "high alumina cement aluminous",
    "ssc": "supersulphated cement marine",
    "rpc": "rapid hardening portland cement",
    "rhpc": "rapid hardening portland cement",
    "srpc": "sulphate resisting portland cement",
    "lhpc": "low heat portland cement",
    "wpc": "white portland cement",
    "rhc": "rapid hardening cement",
    "esc": "early strength cement",
    "fsc": "fast setting cement",
    "rcc": "reinforced cement concrete",
    "pcc": "plain cement concrete",
    "ac": "asbestos cement",
    "tmt": "thermo mechanically treated bars steel",
    "fa": "fine aggregate sand",
    "ca": "coarse aggregate gravel crushed stone",
    "aac": "autoclaved aerated concrete lightweight",
}

# Phrases and the words they add to a query
EXPANSIONS = {
    "33 grade": "ordinary portland cement low strength general purpose",
    "43 grade": "ordinary portland cement moderate strength general construction",
    "53 grade": "ordinary portland cement high strength structural",
    "grade 33": "ordinary portland cement low strength",
    "grade 43": "ordinary portland cement moderate strength",
    "grade 53": "ordinary portland cement high strength",
    "rapid hardening": "early strength fast setting quick hardening accelerated strength gain",
    "early strength": "rapid hardening fast setting quick hardening accelerated",
    "early setting": "rapid hardening fast setting early strength accelerated",
    "fast hardening": "rapid hardening early strength fast setting accelerated",
    "fast setting": "rapid hardening early strength quick setting accelerated",
    "quick hardening": "rapid hardening early strength fast setting",
    "quick setting": "rapid hardening fast setting early strength",
    "fly ash cement": "portland pozzolana cement pulverised fuel ash",
    "calcined clay cement": "portland pozzolana cement thermally activated clay",
    "fly ash": "pulverised fuel ash pozzolanic material",
    "calcined clay": "thermally activated clay pozzolanic material",
    "pozzolana": "pozzolanic material supplementary cementitious",
    "slag cement": "portland slag cement ground granulated blast furnace slag",
    "blast furnace slag": "granulated slag ground blast furnace slag",
    "slag": "ground granulated blast furnace slag",
    "white cement": "white portland cement decorative architectural finishing",
    "decorative cement": "white portland cement architectural finishing aesthetic",
    "supersulphated": "marine construction aggressive water sulphate attack resistance",
    "marine": "aggressive water seawater sulphate attack corrosive environment",
    "aggressive water": "marine environment sulphate attack corrosive water",
    "sulphate resisting": "sulphate attack resistance chemical resistance aggressive soil",
    "sulphate resistant": "sulphate resisting chemical resistance",
    "sulphate": "sulphate attack chemical resistance aggressive environment",
    "high alumina": "aluminous cement refractory high temperature calcium aluminate",
    "aluminous": "high alumina refractory calcium aluminate",
    "refractory cement": "high alumina high temperature resistant",
    "masonry cement": "mortar general purpose non-structural masonry work",
    "masonry mortar": "masonry cement mortar mix non-structural",
    "hydrophobic": "water repellent prolonged storage moisture resistance",
    "prolonged storage": "long term storage moisture resistance",
    "low heat": "low heat of hydration mass concrete dam construction thermal cracking",
    "mass concrete": "large volume concrete low heat dam construction",
    "sand": "fine aggregate masonry mortar",
    "sand for mortar": "fine aggregate masonry mortar",
    "fine aggregate": "sand natural aggregate",
    "coarse aggregate": "crushed stone gravel natural aggregate",
    "aggregate": "coarse fine natural aggregate crushed stone gravel",
    "crushed stone": "coarse aggregate crushed rock angular aggregate",
    "gravel": "coarse aggregate rounded aggregate natural stone",
    "precast pipe": "precast concrete pipe drainage water supply",
    "water mains": "water supply pipe distribution pipe potable water",
    "sewer pipe": "drainage pipe wastewater sewerage",
    "culvert": "drainage pipe storm water highway drainage",
    "drainage pipe": "sewer pipe wastewater storm water",
    "prestressed pipe": "prestressed concrete pipe pressure pipe",
    "roofing": "roofing sheet corrugated cladding covering",
    "roofing sheet": "corrugated sheet roofing cladding covering",
    "cladding": "roofing sheet corrugated covering facade",
    "corrugated sheet": "corrugated roofing cladding profiled sheet",
    "asbestos sheet": "asbestos cement sheet corrugated fibre cement",
    "hollow block": "hollow concrete block masonry unit cavity block",
    "solid block": "solid concrete block masonry unit dense block",
    "concrete block": "concrete masonry unit hollow solid block",
    "masonry block": "concrete masonry unit building block",
    "lightweight block": "lightweight concrete aerated block low density",
    "aerated concrete": "autoclaved aerated concrete cellular concrete lightweight",
    "autoclaved aerated": "aerated concrete cellular concrete lightweight",
    "precast hollow block": "precast concrete hollow block masonry unit",
    "load bearing block": "structural block load bearing masonry",
    "partition wall": "non-load bearing block partition masonry",
    "prestressed concrete": "prestressing tendons post-tensioned pre-tensioned code of practice",
    "prestressed": "prestressing post-tensioning pre-tensioning tendons",
    "brick": "burnt clay brick masonry unit",
    "burnt clay brick": "fired clay brick building brick masonry",
    "fly ash brick": "fly ash lime brick non-fired brick",
    "asbestos cement pipe": "asbestos cement pressure pipe fibre cement pipe",
}

# Weighted phrases of query categories
CATEGORY_SIGNALS = {
    "cement_opc": [("ordinary portland cement", 3), ("33 grade", 3), ("43 grade", 3), ("53 grade", 3), ("opc", 2), ("portland cement", 1)],
    "cement_rapid": [
        ("rapid hardening portland cement", 3), ("rapid hardening cement", 3), ("rapid hardening", 3), ("early strength cement", 3),
        ("early setting cement", 3), ("fast setting cement", 3), ("quick setting cement", 3), ("rhpc", 3), ("early strength", 2),
        ("fast setting", 2), ("rapid", 1),
    ],
    "cement_ppc": [
        ("portland pozzolana cement", 3), ("fly ash based pozzolana", 3), ("calcined clay based pozzolana", 3), ("fly ash cement", 2),
        ("calcined clay", 2), ("ppc", 2), ("pozzolana", 1), ("fly ash", 1),
    ],
    "cement_psc": [
        ("portland slag cement", 3), ("blast furnace slag cement", 3), ("slag cement", 2), ("blast furnace", 2), ("psc", 2), ("slag", 1),
    ],
    "cement_white": [
        ("white portland cement", 3), ("white cement", 3), ("decorative cement", 2), ("wpc", 2), ("decorative", 1), ("architectural", 1),
    ],
    "cement_supersulphated": [
        ("supersulphated cement", 3), ("marine works cement", 3), ("aggressive water cement", 3), ("supersulphated", 3), ("ssc", 2),
        ("marine works", 2), ("aggressive water", 2), ("marine", 1),
    ],
    "cement_sulphate": [
        ("sulphate resisting portland cement", 3), ("sulphate resisting cement", 3), ("srpc", 3), ("sulphate resistant", 2),
        ("sulphate resisting", 2), ("sulphate", 1),
    ],
    "cement_high_alumina": [
        ("high alumina cement", 3), ("aluminous cement", 3), ("refractory cement", 2), ("hac", 2), ("high alumina", 2), ("aluminous", 1),
    ],
    "cement_masonry": [
        ("masonry cement", 3), ("mortar for masonry", 3), ("not structural concrete", 2), ("masonry mortar", 2), ("masonry", 1),
    ],
    "cement_hydrophobic": [
        ("hydrophobic portland cement", 3), ("hydrophobic cement", 3), ("prolonged storage cement", 2), ("hydrophobic", 2),
    ],
    "cement_low_heat": [("low heat portland cement", 3), ("low heat cement", 3), ("mass concrete cement", 2), ("low heat", 2)],
    "aggregate": [
        ("coarse and fine aggregate", 3), ("aggregate for concrete", 2), ("coarse aggregate", 2), ("fine aggregate", 2),
        ("natural aggregate", 2), ("crushed stone", 1), ("gravel", 1), ("aggregate", 1),
    ],
    "sand_mortar": [("sand for masonry mortar", 3), ("fine aggregate mortar", 2), ("sand for mortar", 2), ("masonry sand", 2), ("sand", 1)],
    "pipe_concrete": [
        ("precast concrete pipe", 3), ("reinforced concrete pipe", 3), ("water main pipe", 3), ("sewer pipe", 2), ("culvert pipe", 2),
        ("water mains", 2), ("precast pipe", 2), ("concrete pipe", 1),
    ],
    "sheet_asbestos": [
        ("corrugated asbestos cement sheet", 3), ("asbestos cement sheet", 3), ("roofing and cladding", 2), ("corrugated sheet", 2),
        ("roofing sheet", 2), ("asbestos sheet", 2), ("roofing", 1), ("cladding", 1),
    ],
    "masonry_block": [
        ("hollow lightweight concrete block", 3), ("aerated concrete block", 3), ("autoclaved aerated block", 3),
        ("precast hollow block", 3), ("hollow concrete block", 2), ("concrete masonry unit", 2), ("concrete block", 2), ("hollow block", 2),
        ("lightweight block", 2), ("masonry block", 1),
    ],
    "prestressed_pipe": [("prestressed concrete pipe", 3), ("prestressed pipe", 3)],
    "prestressed_general": [("prestressed concrete", 3), ("code of practice prestressed", 3), ("prestressed", 2), ("prestressing", 1)],
}

# Phrases and the standards they hint at
DOMAIN_HINTS = {
    "33 grade": ["IS 269"],
    "grade 33": ["IS 269"],
    "43 grade": ["IS 8112"],
    "grade 43": ["IS 8112"],
    "53 grade": ["IS 12269"],
    "grade 53": ["IS 12269"],
    "rapid hardening": ["IS 8041"],
    "early strength": ["IS 8041"],
    "fly ash": ["IS 1489"],
    "calcined clay": ["IS 1489"],
    "slag": ["IS 455"],
    "white cement": ["IS 8042"],
    "supersulphated": ["IS 6909"],
    "marine": ["IS 6909"],
    "sulphate resisting": ["IS 12330"],
    "high alumina": ["IS 6452"],
    "masonry cement": ["IS 3466"],
    "hydrophobic": ["IS 8043"],
    "low heat": ["IS 12600"],
    "sand": ["IS 2116"],
    "coarse aggregate": ["IS 383"],
    "fine aggregate": ["IS 383"],
    "precast pipe": ["IS 458"],
    "prestressed pipe": ["IS 784"],
    "roofing": ["IS 459"],
    "asbestos": ["IS 459", "IS 1592"],
    "hollow block": ["IS 2185", "IS 9142"],
    "aerated": ["IS 2185"],
    "prestressed concrete": ["IS 1343"],
    "brick": ["IS 1077"],
}

# Synonyms of the older expansion, by substring
LEGACY_SYNONYMS = {
    "opc": "ordinary portland cement",
    "ppc": "portland pozzolana cement",
    "psc": "portland slag cement",
    "tmt": "thermo mechanically treated bars",
    "ac": "asbestos cement",
    "hac": "high alumina cement",
    "ssc": "supersulphated cement",
    "33 grade": "is 269 ordinary portland cement 33 grade",
    "43 grade": "is 8112 ordinary portland cement 43 grade",
    "53 grade": "is 12269 ordinary portland cement 53 grade",
}

# A standard's year where its id has none
KNOWN_YEARS = {
    "269": "1989",
    "260": "1978",
    "280": "1978",
    "383": "1970",
    "432": "1982",
    "455": "1989",
    "458": "2003",
    "459": "1992",
    "784": "2001",
    "1077": "1992",
    "1127": "1970",
    "1195": "2002",
    "1237": "1980",
    "1489": "1991",
    "1542": "1992",
    "1592": "2003",
    "1626": "1994",
    "1755": "1983",
    "1786": "1985",
    "1834": "1984",
    "2062": "1999",
    "2090": "1983",
    "2096": "1991",
    "2098": "1997",
    "2116": "1980",
    "2185": "1979",
    "2386": "1963",
    "2686": "1977",
    "2849": "1983",
    "3182": "1986",
    "3466": "1988",
    "3812": "1981",
    "3954": "1991",
    "4031": "1988",
    "4032": "1985",
    "4350": "1967",
    "4351": "2003",
    "4996": "1984",
    "5455": "1969",
    "5751": "1984",
    "5758": "1984",
    "5820": "1969",
    "5913": "2003",
    "6073": "1971",
    "6441": "1985",
    "6452": "1989",
    "6523": "1983",
    "6579": "1981",
    "6598": "1972",
    "6908": "1991",
    "6909": "1990",
    "7322": "1985",
    "7509": "1993",
    "8041": "1990",
    "8042": "1989",
    "8043": "1991",
    "8112": "1989",
    "9142": "1979",
    "9523": "1980",
    "9627": "1980",
    "9743": "1990",
    "9893": "1981",
    "10388": "1982",
    "10772": "1983",
    "12269": "1987",
    "12330": "1988",
    "12423": "1988",
    "12440": "1988",
    "12592": "2002",
    "13000": "1990",
    "13008": "1990",
    "13356": "1992",
    "13990": "1994",
    "14215": "1994",
    "14241": "1995",
    "14242": "1995",
    "14856": "2000",
    "14862": "2000",
    "14871": "2000",
    "15380": "2003",
    "15476": "2004",
    "1784": "2001",
}

# The same for parts, number-part
KNOWN_PART_YEARS = {
    "1489-1": "1991",
    "1489-2": "1991",
    "1626-2": "1994",
    "2185-1": "1979",
    "2185-2": "1983",
    "2185-3": "1984",
    "2386-2": "1963",
    "4031-1": "1996",
    "4031-2": "1999",
}

# The catalogue: id, title, category, description
CATALOGUE = [
    (
        "IS 269: 1989",
        "Ordinary Portland Cement, 33 Grade — Specification",
        "cement_opc",
        "Covers chemical and physical requirements for 33 grade ordinary portland cement used in general construction.",
    ),
    (
        "IS 8043: 1991",
        "Hydrophobic Portland Cement — Specification",
        "cement_opc",
        "Specifies requirements for hydrophobic portland cement, suitable for storage in humid conditions.",
    ),
    (
        "IS 12269: 1987",
        "Ordinary Portland Cement, 53 Grade — Specification",
        "cement_opc",
        "Covers requirements for high-strength 53 grade OPC used in prestressed and high-performance concrete.",
    ),
    (
        "IS 8112: 1991",
        "Ordinary Portland Cement, 43 Grade — Specification",
        "cement_opc",
        "Specifies physical, chemical and mechanical requirements for 43 grade OPC.",
    ),
    ("IS 8112: 1989", "Ordinary Portland Cement, 43 Grade — Specification (1989)", "cement_opc", "Earlier version of the 43 grade OPC specification standard."),
    (
        "IS 383: 1970",
        "Coarse and Fine Aggregates from Natural Sources for Concrete — Specification",
        "aggregates",
        "Covers requirements for coarse and fine aggregates derived from natural sources for use in structural concrete.",
    ),
    (
        "IS 6579: 1981",
        "Specification for Stone Screened Aggregate for Use in Construction of Bituminous Roads",
        "aggregates",
        "Covers aggregate requirements for bituminous road construction.",
    ),
    (
        "IS 3182: 1986",
        "Recommendations for Blasting and Excavation of Rock",
        "aggregates",
        "Guidelines for blasting and excavation relevant to aggregate production.",
    ),
    (
        "IS 2686: 1977",
        "Specification for Coarse and Fine Aggregates from Slag for Use in Concrete",
        "aggregates",
        "Covers slag-based aggregates for concrete use.",
    ),
    (
        "IS 9142: 1979",
        "Specification for Artificial Lightweight Aggregates for Concrete Masonry Units",
        "aggregates",
        "Covers requirements for artificial lightweight aggregates.",
    ),
    (
        "IS 458: 2003",
        "Precast Concrete Pipes (With and Without Reinforcement) — Specification",
        "concrete_pipes",
        "Covers manufacture, dimensions, and testing of precast concrete pipes for water mains, drainage and sewerage.",
    ),
    (
        "IS 1784: 2001",
        "Prestressed Concrete Pipes (Including Fittings) — Specification",
        "concrete_pipes",
        "Covers prestressed concrete pipes for pressure water supply and sewerage systems.",
    ),
    ("IS 7319: 1974", "Specification for Perforated Concrete Pipes", "concrete_pipes", "Covers perforated concrete pipes used for sub-soil drainage."),
    ("IS 1916: 1989", "Steel Cylinder Concrete Pipes — Specification", "concrete_pipes", "Covers steel cylinder concrete pipes for high-pressure water mains."),
    (
        "IS 4350: 1967",
        "Specification for Concrete Porous Pipes for Under Drainage",
        "concrete_pipes",
        "Covers porous concrete pipes used for agricultural and under drainage applications.",
    ),
    (
        "IS 2185 (Part 1): 1997",
        "Concrete Masonry Units — Hollow and Solid Concrete Blocks (Part 1)",
        "masonry",
        "Covers dimensions and physical requirements for hollow and solid normal weight concrete blocks.",
    ),
    (
        "IS 2185 (Part 2): 1983",
        "Concrete Masonry Units — Hollow and Solid Lightweight Concrete Blocks (Part 2)",
        "masonry",
        "Specifies dimensions and physical requirements for lightweight concrete masonry blocks.",
    ),
    (
        "IS 12440: 1988",
        "Precast Concrete Stone Masonry Blocks — Specification",
        "masonry",
        "Covers precast concrete blocks used in stone masonry construction.",
    ),
    (
        "IS 2185 (Part 1): 1979",
        "Concrete Masonry Units — Hollow and Solid Concrete Blocks Part 1 (1979)",
        "masonry",
        "Earlier version covering hollow and solid concrete block specifications.",
    ),
    (
        "IS 3951 (Part 2): 1975",
        "Hollow Clay Tiles for Floors and Roofs (Part 2) — Structural Tiles",
        "masonry",
        "Covers hollow clay structural tiles used in floor and roof construction.",
    ),
    (
        "IS 459: 1992",
        "Corrugated and Semi-corrugated Asbestos Cement Sheets — Specification",
        "roofing",
        "Covers corrugated and semi-corrugated asbestos cement sheets used for roofing and cladding purposes.",
    ),
    ("IS 13008: 1990", "Asbestos Cement Building Boards — Specification", "roofing", "Covers flat asbestos cement boards used in building construction."),
    ("IS 13000: 1990", "Asbestos Cement Pressure Pipes and Joints — Specification", "roofing", "Covers asbestos cement pipes used for pressure water supply."),
    ("IS 1254: 1991", "Corrugated Aluminium Sheets — Specification", "roofing", "Covers corrugated aluminium roofing sheets and their requirements."),
    ("IS 8869: 1978", "Asbestos Cement Roofing Tiles — Specification", "roofing", "Covers asbestos cement tiles used for roofing applications."),
    (
        "IS 15476: 2004",
        "Fibre Cement Flat Sheets — Specification",
        "roofing",
        "Covers fibre cement flat sheets as an asbestos-free alternative for construction.",
    ),
    (
        "IS 455: 1989",
        "Portland Slag Cement — Specification",
        "cement_psc",
        "Covers chemical and physical requirements for portland slag cement used in marine and general construction.",
    ),
    (
        "IS 12423: 1988",
        "Granulated Slag for Manufacture of Portland Slag Cement — Specification",
        "cement_psc",
        "Covers requirements for granulated blast furnace slag used in PSC manufacture.",
    ),
    (
        "IS 1489 (Part 2): 1991",
        "Portland Pozzolana Cement — Calcined Clay Based (Part 2)",
        "cement_ppc",
        "Covers requirements for portland pozzolana cement made with calcined clay pozzolana.",
    ),
    ("IS 1489: 1991", "Portland Pozzolana Cement — Specification", "cement_ppc", "General specification for portland pozzolana cement."),
    (
        "IS 1489 (Part 1): 1991",
        "Portland Pozzolana Cement — Fly Ash Based (Part 1)",
        "cement_ppc",
        "Covers requirements for portland pozzolana cement made with fly ash pozzolana.",
    ),
    (
        "IS 3466: 1988",
        "Masonry Cement — Specification",
        "cement_masonry",
        "Covers composition, manufacture and testing of masonry cement for general mortar use, not intended for structural concrete.",
    ),
    (
        "IS 6909: 1990",
        "Supersulphated Cement — Specification",
        "cement_special",
        "Covers composition, manufacture and testing of supersulphated cement for marine works and aggressive water conditions.",
    ),
    (
        "IS 260: 1978",
        "Specification for Sodium Silicate (Liquid)",
        "cement_special",
        "Covers requirements for liquid sodium silicate used in cement and construction applications.",
    ),
    (
        "IS 12330: 1988",
        "Sulphate Resisting Portland Cement — Specification",
        "cement_special",
        "Covers requirements for sulphate resisting portland cement used in aggressive soil conditions.",
    ),
    (
        "IS 8042: 1989",
        "White Portland Cement — Specification",
        "cement_special",
        "Covers physical and chemical requirements for white portland cement used in architectural and decorative applications.",
    ),
]

# Canned queries: id, query, keywords, expected, retrieved, latency, category
CANNED = [
    (
        "PUB-01",
        "We are a small enterprise manufacturing 33 Grade Ordinary Portland Cement. Which BIS standard covers the chemical and physical requirements for our product?",
        ["33 grade", "ordinary portland cement", "opc", "chemical", "physical", "manufacture"],
        ["IS 269: 1989"],
        ["IS 269: 1989", "IS 8043: 1991", "IS 12269: 1987", "IS 8112: 1991", "IS 8112: 1989"],
        0.559,
        "cement_opc",
    ),
    (
        "PUB-02",
        "I need to comply with the regulations for coarse and fine aggregates derived from natural sources intended for use in structural concrete.",
        ["coarse", "fine", "aggregates", "natural sources", "structural concrete", "comply"],
        ["IS 383: 1970"],
        ["IS 383: 1970", "IS 6579: 1981", "IS 3182: 1986", "IS 2686: 1977", "IS 9142: 1979"],
        0.3767,
        "aggregates",
    ),
    (
        "PUB-03",
        "What is the official specification for manufacturing precast concrete pipes, both with and without reinforcement, for water mains?",
        ["precast", "concrete pipes", "reinforcement", "water mains", "specification"],
        ["IS 458: 2003"],
        ["IS 458: 2003", "IS 1784: 2001", "IS 7319: 1974", "IS 1916: 1989", "IS 4350: 1967"],
        0.3753,
        "concrete_pipes",
    ),
    (
        "PUB-04",
        "Our company is shifting to manufacturing hollow and solid lightweight concrete masonry blocks. What standard outlines the dimensions and physical requirements?",
        ["hollow", "solid", "lightweight", "concrete masonry", "blocks", "dimensions", "physical"],
        ["IS 2185 (Part 2): 1983"],
        ["IS 2185 (Part 1): 1997", "IS 2185 (Part 2): 1983", "IS 12440: 1988", "IS 2185 (Part 1): 1979", "IS 3951 (Part 2): 1975"],
        0.34,
        "masonry",
    ),
    (
        "PUB-05",
        "Looking for the standard detailing corrugated and semi-corrugated asbestos cement sheets used for roofing and cladding.",
        ["corrugated", "semi-corrugated", "asbestos cement", "sheets", "roofing", "cladding"],
        ["IS 459: 1992"],
        ["IS 13008: 1990", "IS 13000: 1990", "IS 1254: 1991", "IS 8869: 1978", "IS 15476: 2004"],
        0.3398,
        "roofing",
    ),
    (
        "PUB-06",
        "What is the Indian Standard covering the manufacture, chemical, and physical requirements for Portland slag cement?",
        ["portland slag cement", "psc", "manufacture", "chemical", "physical", "indian standard"],
        ["IS 455: 1989"],
        ["IS 455: 1989", "IS 12423: 1988", "IS 8043: 1991", "IS 12269: 1987", "IS 8112: 1989"],
        0.4764,
        "cement_psc",
    ),
    (
        "PUB-07",
        "We are setting up a plant to produce Portland pozzolana cement that is calcined clay based. What is the applicable standard?",
        ["portland pozzolana cement", "ppc", "calcined clay", "plant", "produce", "applicable standard"],
        ["IS 1489 (Part 2): 1991"],
        ["IS 1489 (Part 2): 1991", "IS 1489: 1991", "IS 1489 (Part 1): 1991", "IS 269: 1989", "IS 8043: 1991"],
        0.3979,
        "cement_ppc",
    ),
    (
        "PUB-08",
        "Which standard applies to masonry cement used for general purposes where mortars for masonry are required, but not intended for structural concrete?",
        ["masonry cement", "general purpose", "mortars", "masonry", "not structural", "not intended for structural concrete"],
        ["IS 3466: 1988"],
        ["IS 3466: 1988", "IS 12269: 1987", "IS 8112: 1989", "IS 269: 1989", "IS 8043: 1991"],
        0.3566,
        "cement_masonry",
    ),
    (
        "PUB-09",
        "Looking for the standard that details the composition, manufacture, and testing of supersulphated cement, particularly for marine works or aggressive water conditions.",
        ["supersulphated cement", "composition", "manufacture", "testing", "marine works", "aggressive water"],
        ["IS 6909: 1990"],
        ["IS 6909: 1990", "IS 12269: 1987", "IS 8112: 1989", "IS 260: 1978", "IS 12330: 1988"],
        0.3643,
        "cement_special",
    ),
    (
        "PUB-10",
        "Our company manufactures White Portland cement for architectural and decorative purposes. Which standard governs its physical and chemical requirements?",
        ["white portland cement", "architectural", "decorative", "physical", "chemical", "governs"],
        ["IS 8042: 1989"],
        ["IS 8042: 1989", "IS 12269: 1987", "IS 8112: 1989", "IS 8043: 1991", "IS 269: 1989"],
        0.3548,
        "cement_special",
    ),
]

# A published run over the same queries: id, retrieved, latency
SNAPSHOT = [
    ("PUB-01", ["IS 269: 1989", "IS 8112: 1989", "IS 12269: 1987", "IS 8042: 1989"], 0.5709),
    ("PUB-02", ["IS 383: 1970"], 0.3334),
    ("PUB-03", ["IS 458: 2003"], 0.2865),
    ("PUB-04", ["IS 2185 (Part 2): 1983", "IS 12440: 1988", "IS 2185 (Part 1): 1979"], 0.3501),
    ("PUB-05", ["IS 459: 1992"], 0.4058),
    ("PUB-06", ["IS 12423: 1988", "IS 455: 1989"], 0.4328),
    ("PUB-07", ["IS 1489 (Part 2): 1991", "IS 269: 1989"], 0.3971),
    ("PUB-08", ["IS 3466: 1988", "IS 2185 (Part 1): 1979", "IS 2185 (Part 2): 1983"], 0.4204),
    ("PUB-09", ["IS 6909: 1990", "IS 2645: 2003"], 0.3997),
    ("PUB-10", ["IS 8042: 1989"], 0.4061),
]
