"""Keyword nets: substring tests over free text, compiled to one alternation each."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The disease nets in their order of priority.
DISEASE_NETS: dict[str, tuple[str, ...]] = {
    "cardiovascular": ("cardiovasc", "cardiac", "heart failure", "myocardial infarct", "coronary artery", "atherosclerosis", "cardiomyopathy", "arrhythmia", "atrial fibrillation", "hypertension", "ischemic heart", "aortic", "vascular disease", "congestive heart", "cardiac hypertrophy", "cardiac fibrosis"),
    "cancer_neoplasm": ("cancer", "carcinoma", "adenocarcinoma", "sarcoma", "leukemia", "lymphoma", "melanoma", "glioma", "glioblastoma", "tumor", "tumour", "neoplasm", "metastasis", "metastatic", "malignant", "myeloma", "myelodysplastic", "hepatocellular"),
    "neurological": ("alzheimer", "parkinson", "huntington", "amyotrophic lateral sclerosis", "als disease", "multiple sclerosis", "epilep", "schizophrenia", "autism", "asd disorder", "dementia", "neurodegener", "stroke", "cerebral palsy", "migraine", "spinal cord injury"),
    "infectious": ("hiv", "aids", "hepatitis", "tuberculosis", "influenza", "covid", "sars-cov", "sars cov", "coronavirus", "malaria", "sepsis", "bacterial infection", "viral infection", "pneumonia", "ebola", "zika", "dengue"),
    "metabolic_endocrine": ("diabetes", "diabetic", "obesity", "obese", "metabolic syndrome", "insulin resistance", "thyroid", "hypothyroid", "hyperthyroid", "polycystic ovary", "pcos", "cushing", "adrenal insufficiency", "hyperlipidemia"),
    "autoimmune": ("lupus", "systemic lupus", "rheumatoid arthritis", "psoriasis", "crohn", "ulcerative colitis", "inflammatory bowel disease", "ibd disease", "sjogren", "scleroderma", "vasculitis", "autoimmun", "type 1 diabetes", "graves disease", "hashimoto"),
    "respiratory": ("asthma", "copd", "chronic obstructive pulmonary", "cystic fibrosis", "pulmonary fibrosis", "idiopathic pulmonary", "bronchi", "emphysema", "sleep apnea", "ards"),
    "renal": ("renal", "kidney disease", "chronic kidney", "nephr", "glomerulonephritis", "dialysis", "polycystic kidney"),
    "musculoskeletal": ("osteoarthritis", "osteoporosis", "arthritis", "musculoskeletal", "muscular dystrophy", "sarcopenia", "fibromyalgia", "ankylosing spondylitis"),
}
UNLABELED = "unclear_unlabeled"
TISSUE_NET: tuple[str, ...] = ("heart", "cardiac muscle", "myocardium", "myocardial", "left ventricle", "right ventricle", "ventricular", "atrium", "atrial appendage", "aorta", "aortic", "coronary artery", "vascular smooth muscle", "endothelial", "cardiomyocyte", "cardiovascular")
SUBTYPE_NETS: dict[str, tuple[str, ...]] = {
    "heart_failure": ("heart failure", "congestive heart", "hfref", "hfpef", "dilated cardiomyopathy", " dcm ", "(dcm)", "ischemic cardiomyopathy", " icm ", "(icm)"),
    "arrhythmia_afib": ("arrhythmia", "atrial fibrillation", "afib", "a-fib", "ventricular tachycardia", "long qt", "brugada"),
    "coronary_artery_disease": ("coronary artery disease", " cad ", "(cad)", "coronary artery", "myocardial infarct", "ischemic heart", "atherosclerosis"),
    "cardiomyopathy_other": ("cardiomyopathy", "hypertrophic cardiomyopathy", "restrictive cardiomyopathy", "arrhythmogenic right ventricular cardiomyopathy", "arvc", "cardiac hypertrophy", "cardiac fibrosis"),
    "hypertension": ("hypertension", "hypertensive", "high blood pressure"),
}
UNRESOLVED, TISSUE_ONLY, LEGACY = "disease_matched_subtype_unresolved", "tissue_only_disease_unconfirmed", "other_unspecified_cvd"
DISPLAY_NAMES: dict[str, str] = {
    "cardiovascular": "Cardiovascular",
    "cancer_neoplasm": "Cancer / neoplasm",
    "neurological": "Neurological",
    "infectious": "Infectious",
    "metabolic_endocrine": "Metabolic / endocrine",
    "autoimmune": "Autoimmune",
    "respiratory": "Respiratory",
    "renal": "Renal",
    "musculoskeletal": "Musculoskeletal",
    "unclear_unlabeled": "Unclear / unlabeled",
    "heart_failure": "Heart failure (DCM + ICM)",
    "arrhythmia_afib": "Arrhythmia / AFib",
    "coronary_artery_disease": "Coronary artery disease",
    "cardiomyopathy_other": "Cardiomyopathy (other)",
    "hypertension": "Hypertension",
    "disease_matched_subtype_unresolved": "Disease-matched, subtype unresolved",
    "tissue_only_disease_unconfirmed": "Tissue-only, disease status unconfirmed",
    "other_unspecified_cvd": "Other / unspecified CVD (legacy)",
}
# Fixed values end.


def pattern(words) -> str:
    """An alternation of literals that Java and RE2 read alike; matches nothing for an empty net."""
    return "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", w.lower()) for w in words) or "[^\\s\\S]"


def hits(text: Column, words) -> Column:
    """Whether the lower-cased text contains any of the words; null text: false."""
    return F.coalesce(F.lower(text).rlike(pattern(words)), F.lit(False))


def haystack(*fields: Column, sep: str = " || ") -> Column:
    """Fields joined in lower case; a null field counts as empty (concat_ws alone would drop it)."""
    return F.lower(F.concat_ws(sep, *[F.coalesce(f, F.lit("")) for f in fields]))


def first_match(text: Column, nets: dict, default: str | None = UNLABELED) -> Column:
    """The first net, in order, that hits."""
    out = None
    for name, words in nets.items():
        out = F.when(hits(text, words), name) if out is None else out.when(hits(text, words), name)
    return out.otherwise(F.lit(default))


def all_matches(text: Column, nets: dict) -> Column:
    """All nets that hit, in order; the first element is ``first_match``'s answer."""
    return F.filter(F.array(*[F.when(hits(text, words), name) for name, words in nets.items()]), lambda x: x.isNotNull())


def all_matches_of_lower(text: Column, nets: dict) -> Column:
    """As ``all_matches`` of text that is in lower case already and not null, for many nets over long texts.

    Java tries each word of a net at each character; Arrow's expressions read a text once per net, however many words it has.
    """
    names, patterns = list(nets), [pattern(words) for words in nets.values()]

    @F.arrow_udf("array<string>")
    def matched(hay: pa.Array) -> pa.Array:
        hit = np.zeros((len(hay), len(names)), bool)
        for i, p in enumerate(patterns):
            hit[:, i] = pc.match_substring_regex(hay, pattern=p).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], hit.sum(axis=1).cumsum()]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(names, pa.string()).take(pa.array(np.nonzero(hit)[1])))

    return matched(text)


def subtype(text: Column, is_disease: Column, nets: dict = SUBTYPE_NETS) -> Column:
    """Without a disease hit a tissue-only label, whatever else matches; with one the first subtype, or unresolved."""
    return F.when(~is_disease, TISSUE_ONLY).otherwise(first_match(text, nets, UNRESOLVED))


def canonical_subtype(old: Column, is_disease: Column) -> Column:
    """Old catch-all labels under the present two; other labels stay."""
    return F.when(old != LEGACY, old).when(is_disease, UNRESOLVED).otherwise(TISSUE_ONLY)


def display_name(slug: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in DISPLAY_NAMES.items() for x in kv]), slug)
