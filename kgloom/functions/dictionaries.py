"""Fixed values of the data model: names, aliases and keyword lists that results depend on."""

from __future__ import annotations

# Node types.
NODE_TYPES = ["concept", "process", "material", "measurement", "formula", "method", "condition", "organism", "author", "journal", "keyword"]

# Other names of node types.
NODE_TYPE_ALIASES = {
    "node": "concept", "entity": "concept", "paper": "concept", "document": "concept",
    "chemical": "material", "protein": "material", "enzyme": "material", "compound": "material", "gene": "material",
    "reaction": "process", "pathway": "process", "mechanism": "process",
    "value": "measurement", "data": "measurement", "result": "measurement",
    "equation": "formula", "calculation": "formula",
    "technique": "method", "protocol": "method", "assay": "method",
    "parameter": "condition", "environment": "condition",
    "species": "organism", "plant": "organism", "animal": "organism",
}

# Relationship types.
RELATIONSHIP_TYPES = ["RELATED_TO", "INFLUENCES", "DEPENDS_ON", "MEASURED_BY", "CALCULATED_BY", "PART_OF", "CAUSES", "CORRELATES_WITH", "DEFINED_AS", "INHIBITS", "ACTIVATES", "CATALYZES", "REGULATES", "BINDS_TO", "SIMILAR_TO"]

# Other names of relationship types.
RELATIONSHIP_ALIASES = {
    "RELATES_TO": "RELATED_TO", "CONNECTED_TO": "RELATED_TO", "ASSOCIATED_WITH": "RELATED_TO",
    "AFFECTS": "INFLUENCES", "IMPACTS": "INFLUENCES", "MODIFIES": "INFLUENCES",
    "REQUIRES": "DEPENDS_ON", "NEEDS": "DEPENDS_ON", "RELIES_ON": "DEPENDS_ON",
    "CONTAINS": "PART_OF", "INCLUDES": "PART_OF", "HAS": "PART_OF",
    "LEADS_TO": "CAUSES", "RESULTS_IN": "CAUSES", "PRODUCES": "CAUSES",
    "CORRELATED_WITH": "CORRELATES_WITH", "LINKED_TO": "CORRELATES_WITH",
    "IS": "DEFINED_AS", "EQUALS": "DEFINED_AS", "REPRESENTS": "DEFINED_AS",
    "BLOCKS": "INHIBITS", "PREVENTS": "INHIBITS", "REDUCES": "INHIBITS",
    "STIMULATES": "ACTIVATES", "ENHANCES": "ACTIVATES", "PROMOTES": "ACTIVATES",
    "CONTROLS": "REGULATES", "MANAGES": "REGULATES",
    "INTERACTS_WITH": "BINDS_TO", "CONNECTS_TO": "BINDS_TO",
}

# Topical categories and their keywords, in order.
TOPIC_KEYWORDS = {
    "Plant Science": ["plant", "crop", "agriculture", "leaf", "stem", "root", "flower", "growth", "development", "germination", "seed", "fruit", "yield", "drought", "stress", "resistance", "tolerance", "adaptation"],
    "Genetics": ["gene", "genetic", "genome", "dna", "rna", "mutation", "allele", "transgenic", "crispr", "genome editing", "qtl", "gwas", "expression", "regulation", "transcription", "inheritance"],
    "Molecular Biology": ["molecular", "protein", "structure", "crystallography", "biochemistry", "molecular dynamics", "binding", "interaction", "complex formation"],
    "Physiology": ["physiology", "metabolism", "enzyme", "biochemical", "pathway", "transport", "osmotic", "water relation", "nutrient", "hormone", "signal transduction", "cellular"],
    "Biotechnology": ["biotechnology", "engineering", "synthetic", "artificial", "bioengineering", "directed evolution", "protein design", "metabolic engineering"],
    "Biophysics": ["biophysics", "quantum", "energy transfer", "fluorescence", "spectroscopy", "electron transport", "thermodynamics", "kinetics", "modeling", "simulation", "physics"],
    "Ecology & Env.": ["ecology", "ecosystem", "environment", "climate", "carbon cycle", "global warming", "atmospheric", "field study", "natural", "biodiversity", "competition", "adaptation", "environmental science", "pollution", "conservation", "ecophysiology"],
    "Systems Biology": ["systems biology", "computational", "bioinformatics", "machine learning", "algorithm", "database", "prediction", "modeling", "artificial intelligence", "data mining", "network analysis", "omics", "integration", "simulation"],
}

# Periods of the temporal trend, first and last year.
PERIODS = [("1995-1999", 1995, 1999), ("2000-2004", 2000, 2004), ("2005-2009", 2005, 2009), ("2010-2014", 2010, 2014), ("2015-2019", 2015, 2019), ("2020-2025", 2020, 2025)]

# Words that decide a node's type, in order.
TYPE_WORDS = {
    "concept": ["theory", "model", "concept", "principle", "framework", "hypothesis"],
    "process": ["process", "procedure", "mechanism", "reaction", "synthesis", "pathway", "cycle"],
    "material": ["compound", "material", "substance", "chemical", "polymer", "enzyme", "protein"],
    "measurement": ["measurement", "value", "result", "data", "analysis", "concentration", "rate"],
    "formula": ["equation", "formula", "expression", "calculation", "coefficient"],
    "method": ["method", "technique", "approach", "protocol", "procedure", "assay"],
    "condition": ["condition", "parameter", "temperature", "pressure", "ph", "humidity", "intensity"],
}

# Phrases that name a relationship, in order.
RELATION_PHRASES = {
    "INFLUENCES": ["affects", "influences", "impacts", "modifies", "alters", "changes"],
    "DEPENDS_ON": ["depends", "relies on", "requires", "needs", "based on"],
    "MEASURED_BY": ["measured by", "determined by", "quantified by", "assessed by"],
    "CALCULATED_BY": ["calculated by", "computed using", "derived from", "estimated by"],
    "PART_OF": ["part of", "component of", "element of", "contains", "includes"],
    "CAUSES": ["causes", "leads to", "results in", "produces", "generates"],
    "CORRELATES_WITH": ["correlates", "associated with", "related to", "linked to"],
    "DEFINED_AS": ["defined as", "is", "equals", "represents", "means"],
    "INHIBITS": ["inhibits", "blocks", "prevents", "reduces", "decreases"],
    "ACTIVATES": ["activates", "stimulates", "enhances", "increases", "promotes"],
}

# Weight of a relationship type; 2 for others.
RELATION_WEIGHTS = {"CAUSES": 5, "INHIBITS": 5, "ACTIVATES": 5, "INFLUENCES": 4, "MEASURED_BY": 4, "CALCULATED_BY": 4, "PART_OF": 3, "DEPENDS_ON": 3}

# Keyword groups of the field.
KEYWORD_GROUPS = {
    "photosynthesis": ["photosynthesis", "photosynthetic", "photosynthetic process"],
    "chlorophyll": ["chlorophyll", "chlorophyll a", "chlorophyll b", "chlorophyll content"],
    "thylakoid": ["thylakoid", "thylakoid membrane", "thylakoid membranes", "grana thylakoid"],
    "photosystem": ["photosystem", "photosystem i", "photosystem ii", "psi", "psii"],
    "heat stress": ["heat stress", "heat", "thermal stress", "high temperature"],
    "drought": ["drought", "drought stress", "water stress", "dehydration"],
    "salt stress": ["salt stress", "salinity", "salt tolerance"],
    "light stress": ["light stress", "high light", "excess light", "photoinhibition"],
    "carbon fixation": ["carbon fixation", "co2 fixation", "calvin cycle"],
    "electron transport": ["electron transport", "electron transport chain", "etc"],
    "atp synthase": ["atp synthase", "atpase", "atp synthesis"],
    "chlorophyll fluorescence": ["chlorophyll fluorescence", "fluorescence", "npq"],
    "rubisco": ["rubisco", "ribulose bisphosphate carboxylase", "rbcl"],
    "c4": ["c4", "c4 photosynthesis", "c4 pathway"],
    "cam": ["cam", "crassulacean acid metabolism"],
    "light harvesting": ["light harvesting", "light harvesting complex", "lhc"],
}

# Patterns of citations, formulas and measured values.
CITATION_PATTERNS = [r"\[(\d+(?:,\s*\d+)*)\]", r"\((\d+)\)", r"(\w+\s+et\s+al\.?\s*\(\d{4}\))", r"(\w+\s*\(\d{4}\))"]
FORMULA_PATTERNS = [r"[A-Za-z]\s*=\s*[^,.\n]+", r"\$[^$]+\$", r"[α-ωΑ-Ω]\s*=\s*[^,.\n]+"]
VALUE_PATTERNS = [r"\d+(?:\.\d+)?\s*±\s*\d+(?:\.\d+)?\s*[a-zA-Z/°%μ]+", r"\d+(?:\.\d+)?-\d+(?:\.\d+)?\s*[a-zA-Z/°%μ]+", r"\d+(?:\.\d+)?\s*×\s*10\^?-?\d+\s*[a-zA-Z/°%μ]+", r"\d+(?:\.\d+)?\s*[a-zA-Z/°%μ]+"]
NUMERIC_CUES = [r"\d+\.?\d*\s*[±×]\s*\d+\.?\d*", r"(?i)\d+\.?\d*\s*(mg|kg|g|ml|l|%|°c|°f)", r"(?i)(\d+\.?\d*)\s*to\s*(\d+\.?\d*)"]

# Patterns of scientific terms.
SCIENTIFIC_PATTERNS = [
    r"\b(protein|enzyme|molecule|compound|acid|base|ion|reaction)\b",
    r"\b(temperature|pressure|concentration|rate|efficiency)\b",
    r"\b(photosynthesis|respiration|metabolism|synthesis)\b",
    r"\b(chlorophyll|thylakoid|chloroplast|mitochondria)\b",
    r"\b(carbon|nitrogen|oxygen|hydrogen|dioxide)\b",
    r"\b(atp|adp|nadph|fadh|rubisco|psii|psi)\b",
    r"\b(glucose|fructose|sucrose|starch|cellulose)\b",
    r"\b(photosystem|thylakoid|stroma|grana)\b",
]

# File kinds by extension.
FILE_KINDS = {"csv": "csv", "json": "json", "pdf": "pdf", "txt": "text", "xlsx": "excel", "xls": "excel"}
