"""The feature plan: every feature group into one vector, in a fixed order."""

from __future__ import annotations

from itertools import groupby

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewright import vocabulary as V
from zonewright.functions import host, record_data, scan_tags
from zonewright.operators.base import Stage
from zonewright.operators.choose import ImportanceSelector
from zonewright.operators.encode import CategoryEncoder, NumericScaler
from zonewright.operators.vectorize import KeywordFlags, TermWeights


class HostFeatures(Transformer, Stage):
    SETTINGS = {
        "column": "fqdn",
        "rules": list(V.PUBLIC_SUFFIXES),
        "keywords": V.HOST_KEYWORDS,
        "word_boundary": False,
    }

    def feature_names(self) -> list[str]:
        structure = [c for c in host.STRUCTURE_COLUMNS if c != "fqdn_subdomain_depth" or self.get("rules") is not None]
        return structure + sorted(f"fqdn_{n}" for n in self.get("keywords"))

    def _transform(self, df: DataFrame) -> DataFrame:
        return host.host_features(
            df, self.get("column"), self.get("rules"), self.get("keywords"), self.get("word_boundary")
        )


class RecordFeatures(Transformer, Stage):
    SETTINGS = {
        "data_column": "record_data",
        "type_column": "record_type",
        "host_column": "fqdn",
        "host_domain": None,
        "rules": list(V.PUBLIC_SUFFIXES),
    }

    def feature_names(self) -> list[str]:
        return list(record_data.FEATURE_NAMES)

    def _transform(self, df: DataFrame) -> DataFrame:
        data = self.get("data_column")
        given = df if data in df.columns else df.withColumn(data, F.lit(None).cast("string"))
        out = record_data.record_features(
            given, data, self.get("type_column"), self.get("host_column"), self.get("rules"),
            host_domain=self.get("host_domain"),
        )
        missing = [c for c in record_data.FEATURE_NAMES if c not in out.columns]
        out = out.withColumns({c: F.lit(0) for c in missing})
        return out if data in df.columns else out.drop(data)


class ScanFeatures(Transformer, Stage):
    SETTINGS = {"column": "scan_result"}

    def feature_names(self) -> list[str]:
        return scan_tags.feature_names()

    def _transform(self, df: DataFrame) -> DataFrame:
        return scan_tags.scan_features(df, self.get("column"))


class FeatureVector(Transformer, Stage):
    """Scalars and vectors into ``features``; null, NaN and infinite
    numbers become 0. The working columns leave."""

    SETTINGS = {"inputs": [], "names": [], "output": "features", "drop": [], "sizes": {}}

    def feature_names(self) -> list[str]:
        return list(self.get("names"))

    def _transform(self, df: DataFrame) -> DataFrame:
        # Neighbouring numbers go in as one vector: an expression per number makes a generated
        # method of more than 8,000 bytes, which the JVM does not compile.
        finite, inputs, sizes = {}, [], dict(self.get("sizes"))
        for number, columns in groupby(self.get("inputs"), lambda c: isinstance(df.schema[c].dataType, T.NumericType)):
            columns = list(columns)
            if number:
                name = f"__f{len(inputs)}"
                values = F.array(*[F.col(c).cast("double") for c in columns])
                usable = lambda x: F.coalesce(F.when(F.abs(x) < float("inf"), x), F.lit(0.0))  # neither NaN nor infinite
                finite[name] = array_to_vector(F.transform(values, usable))
                sizes[name], columns = len(columns), [name]
            inputs += columns
        out = df.withColumns(finite)
        for c in filter(sizes.__contains__, inputs):  # with its size declared, assembling needs no look at the first row
            out = VectorSizeHint(inputCol=c, size=sizes[c], handleInvalid="optimistic").transform(out)
        out = VectorAssembler(inputCols=inputs, outputCol=self.get("output")).transform(out)
        return out.drop(*finite, *self.get("drop"))


class FeaturePlan(Estimator, Stage):
    """Fit every group whose input column exists; the result is a PipelineModel.

    ``feature_names(model)`` names the elements of ``features``.
    """

    SETTINGS = {
        "host_column": "fqdn",
        "data_column": "record_data",
        "type_column": "record_type",
        "scan_column": "scan_result",
        "description_column": "appdesc",
        "target": "appid",
        "label": "label",
        "categorical_columns": list(V.DEFAULT_CATEGORICAL_COLUMNS),
        "numerical_columns": [],
        "text_columns": ["fqdn"],
        "categorical_strategy": "label",
        "categorical_strategies": {},
        "scaling": "standard",
        "tfidf_max_features": 500,
        "description_max_features": 100,
        "stop_words": None,
        "record_data_features": True,
        "description_features": True,
        "scan_features": True,
        "importance_threshold": None,
    }

    def _fit(self, df: DataFrame) -> PipelineModel:
        stages, inputs, names, vector_sizes = [], [], [], {}

        def add(stage, columns=None, labels=None) -> None:
            if stage.hasParam("vocabulary") and not stage.get("vocabulary"):
                return  # no term was frequent enough
            stages.append(stage)
            inputs.extend(columns if columns is not None else stage.feature_names())
            names.extend(labels if labels is not None else stage.feature_names())

        has = set(df.columns).__contains__
        g = self.get
        if has(g("host_column")):
            add(HostFeatures(column=g("host_column")))
        if g("record_data_features") and has(g("data_column")):
            add(
                RecordFeatures(
                    data_column=g("data_column"), type_column=g("type_column"), host_column=g("host_column"),
                    host_domain="fqdn_domain" if has(g("host_column")) else None,
                )
            )
        if g("scan_features") and has(g("scan_column")):
            add(ScanFeatures(column=g("scan_column")))
        if inputs:  # one column from here on: what follows handles each row's columns again and again
            stages.append(FeatureVector(inputs=list(inputs), names=list(names), output="__numbers", drop=[c for c in inputs if not has(c)]))
            vector_sizes["__numbers"], inputs = len(inputs), ["__numbers"]
        if g("description_features") and has(g("description_column")):
            stop_words = g("stop_words")
            if stop_words is None:
                from pyspark.ml.feature import StopWordsRemover

                stop_words = StopWordsRemover.loadDefaultStopWords("english")
            terms = TermWeights(
                input=g("description_column"), output="__appdesc", analyzer="description", low=1, high=2,
                max_features=g("description_max_features"), max_df=0.9, stop_words=stop_words,
            ).fit(df)
            add(terms, ["__appdesc"])
            add(KeywordFlags(input=g("description_column")))
        for c in filter(has, g("text_columns")):
            terms = TermWeights(input=c, output=f"__{c}_tfidf", max_features=g("tfidf_max_features")).fit(df)
            add(terms, [f"__{c}_tfidf"])
        categorical = [c for c in g("categorical_columns") if has(c)]
        if categorical:
            encoder = CategoryEncoder(
                columns=categorical, strategy=g("categorical_strategy"),
                strategies=g("categorical_strategies"), target=g("target"),
            ).fit(df)
            labels = []
            sizes = encoder.get("defaults")
            for (c, strategy), name in zip(encoder.get("chosen").items(), encoder.feature_names()):
                if strategy == "onehot":
                    vector_sizes[name] = max(int(sizes[c]), 1)
                    labels += [f"{name}_{i}" for i in range(vector_sizes[name])]
                else:
                    labels.append(name)
            add(encoder, encoder.output_columns(), labels)
        numerical = [c for c in g("numerical_columns") if has(c)]
        if numerical:
            scaler = NumericScaler(columns=numerical, method=g("scaling")).fit(df)
            add(scaler, scaler.output_columns(), scaler.feature_names())
        created = [c for c in inputs if not has(c)]
        extra = [c for c in ("fqdn_tld", "fqdn_domain", "fqdn_subdomain", "fqdn_first_label") if not has(c)]
        vector = FeatureVector(inputs=inputs, names=names, drop=created + extra, sizes=vector_sizes)
        plan = PipelineModel([*stages, vector])
        if g("importance_threshold") is not None and has(g("label")):
            vector._set(output="all_features")
            rows = plan.transform(df).where(F.col(g("label")).isNotNull())
            selector = ImportanceSelector(
                features="all_features", output="features", label=g("label"), names=names,
                threshold=g("importance_threshold"),
            ).fit(rows)
            plan = PipelineModel([*stages, vector, selector])
        return plan


def feature_names(model: PipelineModel) -> list[str]:
    return model.stages[-1].feature_names()


def group_columns(df: DataFrame, groups: dict[str, bool], table: dict[str, tuple[str, ...]] = V.FEATURE_GROUPS) -> DataFrame:
    """Only the columns of enabled feature groups (columns in no group stay)."""
    off = {c for g, on in groups.items() if not on for c in table.get(g, ())}
    on = {c for g, cs in table.items() if groups.get(g, True) for c in cs}
    return df.select(*[c for c in df.columns if c not in off or c in on])
