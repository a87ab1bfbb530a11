"""Operations of a training-data pipeline: near and exact deduplication, tokenising,
sharding, mixing, chat formatting, line deduplication, language-model scoring and
toxicity.  Nothing outside this package and ``corpus_pipeline.py`` imports it."""
