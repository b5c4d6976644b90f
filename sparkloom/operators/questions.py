"""Questions: what they ask for, how hard they are, which retrieval they get, and the parts they fall into."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTENTS = ("TROUBLESHOOTING", "COMPARISON", "MULTI_CONCEPT", "PROCEDURE", "EXPLANATION", "FACT_LOOKUP")  # in the order of priority

#: The terms of the domain.
TERMS = [
    *("standardscaler", "minmaxscaler", "robustscaler", "maxabsscaler", "normalizer", "onehotencoder", "ordinalencoder", "labelencoder", "targetencoder"),
    *("simpleimputer", "iterativeimputer", "knnimputer", "polynomialfeatures", "splinetransformer", "columntransformer", "power_transform", "quantiletransformer"),
    *("linearregression", "logisticregression", "ridgeclassifier", "ridge", "lasso", "elasticnet", "lars", "bayesianridge", "sgdclassifier", "sgdregressor"),
    *("linearsvc", "linearsvr", "nusvc", "nusvr", "oneclasssvm", "svc", "svr"),
    *("decisiontreeclassifier", "decisiontreeregressor", "decision tree", "randomforestclassifier", "randomforestregressor", "random forest", "extratreesclassifier", "extratreesregressor"),
    *("gradientboostingclassifier", "gradientboostingregressor", "gradient boosting", "histgradientboostingclassifier", "adaboostclassifier", "adaboostregressor", "votingclassifier", "stackingclassifier"),
    *("kmeans", "minibatchkmeans", "dbscan", "spectralclustering", "agglomerativeclustering", "pca", "incrementalpca", "kernelpca", "truncatedsvd", "fastica", "tsne"),
    *("model selection", "preprocessing", "pipeline", "pipelines", "make_pipeline", "featureunion", "gridsearchcv", "randomizedsearchcv", "halvinggridsearchcv"),
    *("cross_val_score", "cross_validate", "train_test_split", "kfold", "stratifiedkfold", "timeseriessplit", "learning_curve", "validation_curve", "estimators", "transformers"),
    *("confusion_matrix", "classification_report", "roc_auc_score", "f1_score", "accuracy_score", "precision_score", "recall_score", "mean_squared_error", "r2_score"),
    *("cross-validation", "cross validation", "hyperparameter tuning", "hyperparameter", "hyperparameters", "regularization", "l1 regularization", "l2 regularization"),
    *("cost-complexity pruning", "ccp_alpha", "bias-variance tradeoff", "bias-variance", "data leakage", "overfitting", "underfitting", "feature selection"),
    *("dimensionality reduction", "class imbalance", "class weights", "sparse matrix"),
]
LONGEST_FIRST = sorted(TERMS, key=len, reverse=True)

#: The phrases that tell intents and difficulties, without regard to case.
PATTERNS: dict[str, str] = {
    "definition": r"^what\s+(?:is|are)\s+[a-zA-Z0-9_\-\s]+\??$",
    "error_class": r"\b(?:valueerror|typeerror|notfittederror|convergencewarning|userwarning|runtimeerror|attributeerror|keyerror|indexerror|zerodivisionerror|memoryerror)\b",
    "repair": r"\b(?:how\s+(?:to|do\s+i|can\s+i)\s+(?:fix|resolve|solve|debug|troubleshoot|diagnose|prevent|handle))\b|\b(?:troubleshoot|troubleshooting|debug|debugging)\b",
    "failure": r"\b(?:why\s+(?:is|are|does|did|am|do)\b.*\b(?:fail|failing|failed|crash|crashes|crashing|broken|throw|throwing|hang|freeze|leak))\b|\b(?:why\s+is\s+my\b.*\b(?:fail|failing|broken|throwing|not\s+working))\b|"
    r"\b(?:not\s+working|doesn't\s+work|does\s+not\s+work|fails?\s+to\s+converge|failing\s+to\s+converge|nan\s+values?|infinite\s+loop|memory\s+leak)\b",
    "error_word": r"\b(?:error|exception|warning|traceback|stacktrace|bug|crash)\b",
    "comparison": r"\b(?:diff(?:erence|erences)?\s+between)\b|\b(?:compare|comparing|comparison)\b|\b(?:vs\.?|versus)\b|\b(?:in\s+contrast\s+to|compared\s+(?:to|with)|relative\s+to)\b|"
    r"\b(?:trade-?offs?\s+between|pros\s+and\s+cons|advantages\s+and\s+disadvantages)\b|\b(?:which\s+(?:is|one\s+is)\s+(?:better|faster|preferable|more\s+suitable|recommended))\b|"
    r"\b(?:when\s+(?:to|should\s+i)\s+use\b.*\binstead\s+of\b)|\b(?:distinguish\s+between|distinction\s+between)\b|\b(?:better\s+than|faster\s+than|preferred\s+over)\b",
    "interaction": r"\b(?:how\s+do\b.*\b(?:interact|work\s+together|relate))\b|\b(?:interact(?:ion|ions)?\s+between)\b|\b(?:interplay\s+between|synergy\s+between)\b|\b(?:relationship\s+between\b.*\band\b)|"
    r"\b(?:work\s+together)\b|\b(?:combine|combining|integrat(?:e|ing|ion\s+of))\b.*\b(?:with|and)\b|\b(?:joint\s+effect\s+of|interconnectedness)\b|\b(?:end-to-end\s+workflow\s+(?:with|combining))\b",
    "procedure": r"\b(?:how\s+(?:to|do\s+i|can\s+i|should\s+i|would\s+i)\s+(?:use|implement|configure|tune|train|fit|apply|create|build|set\s*up|setup|run|pipeline|save|load|export|import|instantiate|call|write))\b|"
    r"\b(?:how\s+(?:to|do\s+i|can\s+i|should\s+i)\b)|\b(?:steps\s+to|step-by-step\s+guide|tutorial\s+(?:on|for)|guide\s+(?:to|for)|how-to)\b|"
    r"\b(?:code\s+(?:example|snippet|for)|example\s+of\s+using|sample\s+code|syntax\s+for)\b|\b(?:best\s+practices?\s+for\s+(?:implementing|using|configuring))\b",
    "explanation": r"\b(?:why\s+(?:does|do|is|are|would|did))\b|\b(?:explain|explaining|explanation)\b|\b(?:how\s+does\b.*\bwork)\b|\b(?:intuition\s+(?:behind|for)|rationale\s+(?:for|behind)|theory\s+behind)\b|"
    r"\b(?:mathematical\s+(?:formula|foundation|derivation)|under\s+the\s+hood)\b|\b(?:what\s+causes|working\s+principle|underlying\s+mechanism)\b|\b(?:what\s+is\s+the\s+(?:intuition|rationale|purpose|idea\s+behind))\b",
    "fact": r"^what\s+(?:is|are)\s+[a-zA-Z0-9_\-\s]+\??$|\b(?:what\s+(?:is|are))\b|\b(?:definition\s+of|define)\b|\b(?:what\s+is\s+the\s+(?:default\s+value|parameter|attribute|return\s+type|signature))\b|"
    r"\b(?:default\s+(?:value|parameter|setting)|return\s+(?:value|type)|attributes?\s+of)\b|\b(?:parameters?\s+(?:of|for)|arguments?\s+(?:of|for)|signature\s+of)\b|"
    r"\b(?:which\s+(?:module|package|class|method|function))\b|\b(?:meaning\s+of\s+parameter|what\s+does\s+the\s+[a-zA-Z0-9_]+\s+parameter\s+do)\b",
    "scenario": r"\b(?:for\s+(?:large|sparse|high[- ]dimensional|imbalanced)\s+datasets?|with\s+(?:outliers|missing\s+values?|nan)|in\s+the\s+presence\s+of|under\s+what\s+conditions|when\s+data\s+is)\b",
    "compound": r"\b(?:and\s+(?:also|how|why|explain|when\s+to\s+use)|as\s+well\s+as|along\s+with)\b",
    "systemic": r"\b(?:data\s+leakage|cross-validation\s+leakage|custom\s+(?:scorer|transformer|estimator)|pipeline\s+combining)\b",
}

#: Candidates and final chunks by difficulty and intent.
POLICY: dict[tuple[str, str], tuple[int, int]] = {
    ("SIMPLE", "FACT_LOOKUP"): (5, 3),
    **{("SIMPLE", i): (5, 4) for i in INTENTS if i != "FACT_LOOKUP"},
    ("MEDIUM", "EXPLANATION"): (15, 5),
    ("MEDIUM", "PROCEDURE"): (15, 5),
    ("MEDIUM", "COMPARISON"): (20, 6),
    ("MEDIUM", "TROUBLESHOOTING"): (20, 6),
    ("MEDIUM", "MULTI_CONCEPT"): (20, 6),
    ("MEDIUM", "FACT_LOOKUP"): (12, 5),
    ("COMPLEX", "MULTI_CONCEPT"): (30, 10),
    ("COMPLEX", "TROUBLESHOOTING"): (30, 8),
    ("COMPLEX", "COMPARISON"): (25, 8),
    ("COMPLEX", "EXPLANATION"): (25, 8),
    ("COMPLEX", "PROCEDURE"): (25, 8),
    ("COMPLEX", "FACT_LOOKUP"): (25, 8),
}
STRATEGIES = {"SIMPLE": ("DENSE", "LIGHT"), "MEDIUM": ("HYBRID", "MODERATE"), "COMPLEX": ("MULTI_STEP", "DEEP")}
BASE_SCORES = {"FACT_LOOKUP": 1.0, "EXPLANATION": 2.0, "PROCEDURE": 2.0, "COMPARISON": 2.0, "TROUBLESHOOTING": 2.0, "MULTI_CONCEPT": 3.0}


def term_pattern(term: str) -> str:
    return rf"\b{re.escape(term)}\b".replace(r"\ ", " ").replace(r"\-", "-")


def says(query: Column, name: str) -> Column:
    return query.rlike("(?i)" + PATTERNS[name])


def terms(query: Column) -> Column:
    """The domain's terms in the question, the longest first; a term inside another counts too."""
    low = F.lower(query)
    return F.array_compact(F.array(*(F.when(low.rlike(term_pattern(t)), F.lit(t)) for t in LONGEST_FIRST)))


def concepts(found: Column) -> Column:
    """Of the terms found, those that are no part of a longer one found."""
    return F.filter(found, lambda t: ~F.exists(found, lambda other: (other != t) & F.contains(other, t)))


def intents(query: Column, found: Column) -> dict[str, Column]:
    """By intent, whether anything in the question speaks for it."""
    low = F.lower(query)
    definition = says(query, "definition")
    has = lambda *words: reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in words))
    return {
        "TROUBLESHOOTING": ((says(query, "error_class") | says(query, "error_word")) & ~definition) | says(query, "repair") | says(query, "failure"),
        "COMPARISON": says(query, "comparison") | ((F.size(found) >= 2) & has(" or ", " vs ", " versus ")),
        "MULTI_CONCEPT": says(query, "interaction") | ((F.size(found) >= 3) & has(" and ", " with ")),
        "PROCEDURE": says(query, "procedure"),
        "EXPLANATION": says(query, "explanation"),
        "FACT_LOOKUP": says(query, "fact"),
    }


def analyze(questions: DataFrame) -> DataFrame:
    """questions with terms, signals, intent, intent_confidence, complexity_score, complexity, complexity_confidence.

    Questions that are null or blank are left out. signals are the intents spoken for, in the order of priority.
    """
    rows = questions.where(F.trim("query") != "").withColumn("query", F.trim("query")).withColumn("terms", terms(F.col("query")))
    for name, found in intents(F.col("query"), F.col("terms")).items():
        rows = rows.withColumn(f"_{name}", found)
    signals = F.array_compact(F.array(*(F.when(F.col(f"_{i}"), F.lit(i)) for i in INTENTS)))
    rows = rows.withColumn("signals", signals).drop(*(f"_{i}" for i in INTENTS))
    n = F.size("signals")
    rows = rows.withColumn("intent", F.when(n > 0, F.get("signals", F.lit(0))).otherwise("FACT_LOOKUP"))
    rows = rows.withColumn("intent_confidence", F.when(n == 0, 0.5).when(n == 1, 0.95).when(n == 2, 0.85).otherwise(0.75))
    base = F.create_map(*(F.lit(x) for pair in BASE_SCORES.items() for x in pair))[F.col("intent")]
    size = F.size("terms")
    extra = reduce(Column.__add__, (F.when(says(F.col("query"), p), 0.5).otherwise(0.0) for p in ("scenario", "compound", "systemic")))
    rows = rows.withColumn("complexity_score", base + F.when(size >= 3, 1.5).when(size == 2, 0.5).otherwise(0.0) + extra)
    s = F.col("complexity_score")
    rows = rows.withColumn("complexity", F.when(s < 2, "SIMPLE").when(s <= 3, "MEDIUM").otherwise("COMPLEX"))
    sure = F.when(s < 2, F.when(s <= 1.2, 0.9).otherwise(0.8)).when(s <= 3, F.when(s <= 2.8, 0.85).otherwise(0.75)).otherwise(F.when(s >= 3.5, 0.9).otherwise(0.8))
    return rows.withColumn("complexity_confidence", sure)


def plannable(intent: Column, complexity: Column) -> Column:
    """Whether both are known, so that a plan can be made of them; false for nulls."""
    return F.coalesce(intent.isin(*INTENTS) & complexity.isin(*STRATEGIES), F.lit(False))


PLAN = "struct<strategy:string,effort:string,candidate_top_k:int,final_top_k:int,use_reranking:boolean,use_multi_step:boolean,reason:string>"


def route(analyzed: DataFrame) -> DataFrame:
    """analyzed with strategy, effort, candidate_top_k, final_top_k, use_reranking, use_multi_step, low_confidence and reason.

    Rows of an unknown intent or complexity raise: they come from no analysis. The policy is looked up and not joined, as a join's
    keys would be filtered below the analysis, and so analysed again.
    """
    entries = []
    for (c, i), (k, f) in POLICY.items():
        names = ("strategy", "effort", "candidate_top_k", "final_top_k", "use_reranking", "use_multi_step", "reason")
        values = (*STRATEGIES[c], k, f, c != "SIMPLE", c == "COMPLEX", f"{c.lower()} question, intent {i.lower()}: {STRATEGIES[c][0].lower()} retrieval, {k} candidates for {f} chunks")
        entries += [F.lit(f"{c} {i}"), F.struct(*(F.lit(v).alias(n) for n, v in zip(names, values)))]
    known = plannable(F.col("intent"), F.col("complexity"))
    plan = F.when(known, F.create_map(*entries)[F.concat_ws(" ", "complexity", "intent")]).otherwise(F.raise_error(F.lit("unknown intent or complexity")).cast(PLAN))
    low = (F.col("complexity_confidence") < 0.6) | (F.col("intent_confidence") <= 0.5)
    return analyzed.withColumn("_plan", plan).select("*", "_plan.*").drop("_plan").withColumn("low_confidence", low)


#: What connects the concepts of a question that comes without an analysis.
CONNECTORS = (" and ", " with ", " vs ", "together", "interact", "combine")


def decompose(analyzed: DataFrame, most: int = 4) -> DataFrame:
    """query_id, sub_query_id, query_text, target_concept, sub_query_type: one row a part of a question.

    A complex question, or one on how two concepts or more interact, has a part for each of its first concepts and
    one for the first three together, `most` in all. Any other, and a complex one without a concept, is its own only part.
    Questions without an analysis (query_id and query alone) are apart if they have two concepts and a connecting word.
    """
    if most < 1:
        raise ValueError("most must be positive")
    q, i = F.col("query"), F.col("intent")
    if plain := "intent" not in analyzed.columns:
        analyzed = analyzed.where(F.trim("query") != "").withColumns({"query": F.trim("query"), "intent": F.lit(None).cast("string")}).withColumn("terms", terms(F.col("query")))
    rows = analyzed.withColumn("concepts", concepts(F.col("terms")))
    c = F.col("concepts")
    apart = (F.size(c) >= 2) & reduce(Column.__or__, (F.contains(F.lower(q), F.lit(x)) for x in CONNECTORS)) if plain else ((F.col("complexity") == "COMPLEX") | ((i == "MULTI_CONCEPT") & (F.size(c) >= 2))) & (F.size(c) > 0)
    single = F.slice(c, 1, max(1, most - 1))
    facet = lambda t: (
        F.when(i == "TROUBLESHOOTING", F.concat(F.lit("Troubleshooting and common errors with "), t, F.lit(" in scikit-learn")))
        .when(i == "COMPARISON", F.concat(F.lit("Parameters, attributes, and behavior of "), t, F.lit(" in scikit-learn")))
        .when(i == "PROCEDURE", F.concat(F.lit("How to use and configure "), t, F.lit(" in scikit-learn")))
        .otherwise(F.concat(F.lit("How does "), t, F.lit(" work in scikit-learn?")))
    )
    joined = F.array_join(F.slice(c, 1, 3), " and ")
    whole = (
        F.when(i == "TROUBLESHOOTING", F.concat(F.lit("Common pipeline and integration errors combining "), joined))
        .when(i == "COMPARISON", F.concat(F.lit("Comparing and choosing between "), joined, F.lit(" in scikit-learn")))
        .otherwise(F.concat(F.lit("How do "), joined, F.lit(" work together and interact in scikit-learn?")))
    )
    part = lambda text, target, kind: F.struct(text.alias("query_text"), target.alias("target_concept"), F.lit(kind).alias("sub_query_type"))
    singles = F.transform(single, lambda t: part(facet(t), t, "individual_concept"))
    together = F.when((F.size(c) >= 2) & (F.size(single) < most), F.array(part(whole, F.array_join(F.slice(c, 1, 3), " + "), "interaction")))
    own = F.array(part(q, F.coalesce(F.get(c, F.lit(0)), F.lit("general")), "original"))
    parts = F.when(apart, F.when(together.isNotNull(), F.concat(singles, together)).otherwise(singles)).otherwise(own)
    return rows.select("query_id", F.posexplode(parts).alias("n", "part")).select("query_id", F.format_string("sub_%02d", F.col("n") + 1).alias("sub_query_id"), "part.*")


def distribution(analyzed: DataFrame, by: str = "category") -> DataFrame:
    """Questions and mean confidences by intent, complexity and category."""
    return analyzed.groupBy("intent", "complexity", by).agg(F.count("*").alias("questions"), F.round(F.avg("intent_confidence"), 4).alias("intent_confidence"), F.round(F.avg("complexity_confidence"), 4).alias("complexity_confidence"))
