"""The registered queries: each takes a session and a folder of tables and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.functions.text import normalized_words, terms, word_count
from forumlens.operators import (bayes, clean, evaluate, ingest, keywords, neighbours, profile, projection, relevance,
                                 similar_posts, similarity, softmax, split, spread, tfidf, topics, tuning, word_vectors)
from forumlens.operators.tfidf import VocabularyRule
from forumlens.plans import pipelines
from forumlens.session import new_path, stage
from forumlens.sources import fixtures, search, store
from forumlens.sources.schema import SEARCH_DISPLAY
from forumlens.streaming import activity, feed, keyed

TAG = "link_flair_text"
EXCLUDED = "error"
TAGS = ("click", "view")
CLASSES = ("de", "fr")
LANGUAGES = ("de", "en", "es", "fr")
TARGET = 1
KEYWORD = "que"
WORD = "eau"  # the word that similar ones are asked for
# Times between which posts are searched: the first minutes after the tables' first event.
AFTER = 1704067800
BEFORE = 1704099600
PRUNED = VocabularyRule(min_df=3, max_df=0.5, max_features=300)
TUNED = tuning.Choice(PRUNED, alpha=0.5)
UNREACHABLE = [tuning.Choice(), tuning.Choice(VocabularyRule(min_df=1_000_000_000))]
EVERY = 50  # posts that recommendations are asked for
SIX = 6

Query = Callable[[SparkSession, str], DataFrame]


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, SIX) for c in columns})


# search, scans, projections

def search_posts(spark, sf):
    spec = search.SearchSpec(subreddit="src0", keyword=KEYWORD, after=AFTER, before=None, n_posts=20)
    return search.search_posts(fixtures.posts(spark, sf), spec).drop("lang", "quality")


def search_keyword_in_channel(spark, sf):
    posts = fixtures.with_bodies(fixtures.posts(spark, sf), spark, sf)
    return search.live_view(search.search_posts(posts, search.SearchSpec("src0", KEYWORD, n_posts=None)))


def search_stored_posts(spark, sf):
    """The newest posts of a channel and a stretch of time, from a table stored by day and channel."""
    posts = store.read_posts(spark, _stored(spark, sf))
    spec = search.SearchSpec(subreddit="src0", after=AFTER, before=BEFORE, n_posts=50)
    return store.search_stored(posts, spec).select("id", "author", "day", "subreddit", "created_utc", "title")


def posts_on_busy_days(spark, sf):
    """Posts of the days that have more of them than the average day."""
    posts = store.read_posts(spark, _stored(spark, sf))
    per_day = stage(posts.groupBy("day").agg(F.count(F.lit(1)).alias("n")))
    busy = per_day.where(F.col("n") > per_day.agg(F.avg("n")).scalar())
    return store.on_days(posts, busy).select("id", "day", "subreddit", "author")


def _stored(spark, sf) -> str:
    path = new_path(spark, "posts")
    store.write_posts(fixtures.posts(spark, sf), path)
    return path


def scan_channel(spark, sf):
    return search.filter_channel(fixtures.posts(spark, sf), "src0")


def scan_channel_two_tags(spark, sf):
    return clean.with_tags(search.filter_channel(fixtures.posts(spark, sf), "src0"), *TAGS)


def filter_time_range(spark, sf):
    return search.filter_time_range(fixtures.posts(spark, sf), AFTER, BEFORE).select("id", "created_utc", "title")


def filter_keyword(spark, sf):
    return search.filter_keyword(fixtures.posts(spark, sf), KEYWORD).select("id", "title")


def project_display(spark, sf):
    return fixtures.posts(spark, sf).select(*SEARCH_DISPLAY)


def exclude_tag_null_safe(spark, sf):
    return clean.exclude_tag(fixtures.posts(spark, sf), EXCLUDED).select("id", TAG)


def fill_missing_tag(spark, sf):
    return clean.fill_missing_tag(fixtures.posts(spark, sf)).select("id", TAG)


def epoch_and_time(spark, sf):
    """Epoch seconds of each post as a time, and the epoch seconds of its day."""
    p = fixtures.posts(spark, sf)
    time = fixtures.utc_time(F.col("created_utc"))
    return p.select("id", "created_utc", F.date_format(time, "yyyy-MM-dd HH:mm:ss").alias("created_text"),
                    fixtures.seconds_since_epoch(F.to_date(time).cast("timestamp_ntz")).alias("day_utc"))


# profile

def count_by_tag(spark, sf):
    return profile.count_by(fixtures.posts(spark, sf), TAG).orderBy(TAG)


def share_by_tag(spark, sf):
    return _rounded(profile.share_by(fixtures.posts(spark, sf)), "share_pct")


def posts_by_num_comments(spark, sf):
    return profile.count_by(fixtures.posts(spark, sf), "num_comments").orderBy("num_comments")


def posts_by_comments_tag(spark, sf):
    return profile.count_by(fixtures.posts(spark, sf), "num_comments", TAG)


def pivot_comments_by_tag(spark, sf):
    return profile.comments_by_tag_wide(fixtures.posts(spark, sf), TAGS)


def unpivot_comments_by_tag(spark, sf):
    return profile.comments_by_tag_long(profile.comments_by_tag_wide(fixtures.posts(spark, sf), TAGS), TAGS)


def distinct_authors(spark, sf):
    return profile.distinct_with_null(fixtures.posts(spark, sf), "author", "n_authors")


def distinct_tags(spark, sf):
    return profile.distinct_values(fixtures.posts(spark, sf), TAG)


def duplicate_counts(spark, sf):
    return clean.duplicate_counts(fixtures.posts(spark, sf))


def dup_id_violations(spark, sf):
    """The uniqueness check on a table whose first key column repeats."""
    return clean.repeated_keys(fixtures.table(spark, sf, "conversations"), "conv_id")


def dedupe_title_then_url(spark, sf):
    return clean.dedupe_title_then_url(fixtures.posts(spark, sf))


def avg_words_by_tag(spark, sf):
    return _rounded(profile.avg_words_by(fixtures.posts(spark, sf), word_count(F.col("title"))), "avg_words")


def avg_words_overall(spark, sf):
    return _rounded(profile.avg_title_words(fixtures.posts(spark, sf)), "avg_words")


def avg_words_normalized_by_tag(spark, sf):
    words = F.size(normalized_words(F.col("title"))).cast("bigint")
    return _rounded(profile.avg_words_by(fixtures.posts(spark, sf), words), "avg_words")


def avg_posts_per_author_tag(spark, sf):
    return _rounded(profile.avg_posts_per_author_tag(fixtures.posts(spark, sf)), "avg_posts")


def authors_both_tags(spark, sf):
    return profile.authors_of_both_tags(fixtures.posts(spark, sf), *CLASSES, tag_column="lang")


def authors_both_tags_top5(spark, sf):
    return profile.most_active(authors_both_tags(spark, sf))


def table_profile(spark, sf):
    return profile.table_profile(fixtures.posts(spark, sf))


def thread_comment_stats(spark, sf):
    return profile.thread_stats(fixtures.table(spark, sf, "conversations"))


def nested_comment_stats(spark, sf):
    """Number of comments and the first one of threads that arrive with their comments nested."""
    turns = fixtures.table(spark, sf, "conversations").where(F.col("turn") > 0)
    nested = turns.groupBy(F.col("conv_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    threads = nested.select("id", F.transform("turns", lambda t: F.struct(t["text"].alias("body"))).alias("comments"))
    return profile.nested_thread_stats(stage(threads))


# ingest

def upsert_ignore(spark, sf):
    """Labelled posts are stored; a later batch of all posts with new scores adds the others."""
    p = fixtures.posts(spark, sf).select("id", "author", "score", "num_comments", "created_time", TAG)
    later = p.withColumn("score", F.col("score") + 1000)
    return ingest.merged(p.where(F.col(TAG).isNotNull()), later)


def keyed_set_latest(spark, sf):
    """The last document set under each user id."""
    versions = fixtures.table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return ingest.latest_by_key(versions, "user_id", [F.col("ts"), F.col("event_id")])


# text features

def normalize_titles(spark, sf):
    return fixtures.posts(spark, sf).select(  # fixed value: the name of the column
        "id", F.concat_ws(" ", normalized_words(F.col("title"))).alias("preprocs_title"))


def _corpus(spark, sf):
    return stage(pipelines.recommender_corpus(fixtures.posts(spark, sf), EXCLUDED))


def tfidf_weights(spark, sf):
    corpus = stage(pipelines.recommender_corpus(fixtures.posts(spark, sf), EXCLUDED).select("id", "terms"))
    return _rounded(tfidf.weights(*pipelines.tfidf_tables(corpus), docs=corpus), "w")


def vocab_pruned(spark, sf):
    _, vocabulary = pipelines.tfidf_tables(_corpus(spark, sf), PRUNED)
    return _rounded(vocabulary, "idf")


def vocab_size(spark, sf):
    _, vocabulary = pipelines.tfidf_tables(_corpus(spark, sf))
    return vocabulary.agg(F.count(F.lit(1)).alias("n_terms"))


# similarity

def recommend_tfidf_top5(spark, sf):
    corpus = _corpus(spark, sf)
    similar = similarity.recommend_by_tfidf(corpus, *pipelines.tfidf_tables(corpus), TARGET)
    return similarity.attach_posts(similar, corpus, ("id", "author", "title", "subreddit", TAG))


def recommend_tfidf_for(spark, sf):
    """Five similar posts for each post whose id is divisible by fifty."""
    corpus = stage(pipelines.recommender_corpus(fixtures.posts(spark, sf), EXCLUDED).select("id", "terms"))
    weights = stage(tfidf.weights(*pipelines.tfidf_tables(corpus), docs=corpus))
    return similarity.recommend_for(corpus, weights, corpus.where(F.col("id") % EVERY == 0))


def _word_means(spark, sf):
    """Mean word vectors of posts; a word's vector is the mean embedding of the posts using it."""
    docs = stage(fixtures.posts(spark, sf).select("id", normalized_words(F.col("title")).alias("words")))
    embeddings = fixtures.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    both = tfidf.listed_terms(tfidf.joined_terms(docs, "words").join(embeddings, "id"), "words")
    uses = both.select("id", F.explode(F.array_distinct("words")).alias("word"), "embedding")
    size = max(embeddings.agg(F.max(F.size("embedding"))).first()[0] or 0, 0)
    return similarity.document_vectors(docs, stage(similarity.mean_by(uses, "word", "embedding", size)))


def doc_vectors_mean(spark, sf):
    return _word_means(spark, sf).select("id", F.transform("vector", lambda x: F.round(x, SIX)).alias("vector"))


def _attached(spark, sf, similar):
    return similarity.attach_posts(similar, fixtures.posts(spark, sf), ("id", "author", "title", "subreddit", TAG), "cosine_sim")


def recommend_vector_top5(spark, sf):
    vectors = fixtures.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    of_posts = vectors.join(fixtures.posts(spark, sf).select("id"), "id", "left_semi")
    return _attached(spark, sf, similarity.recommend_by_vector(of_posts, TARGET))


def recommend_words_vector_top5(spark, sf):
    """The five posts whose mean word vectors are most similar to that of one post."""
    return _attached(spark, sf, similarity.recommend_by_vector(stage(_word_means(spark, sf)), TARGET))


def _vectors(spark, sf):
    return fixtures.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def recommend_vector_indexed(spark, sf):
    """Five similar vectors, from the index, for each vector whose id is divisible by fifty."""
    vectors = _vectors(spark, sf)
    return neighbours.search(neighbours.build(vectors), vectors.where(F.col("id") % EVERY == 0))


def _lower_words(spark, sf):
    return stage(fixtures.posts(spark, sf).select("id", terms(normalized_words(F.col("title")), lowercase=True).alias("words")))


def word_cooccurrences(spark, sf):
    """How often two words stand near each other in posts."""
    return word_vectors.cooccurrences(_lower_words(spark, sf))


def similar_words(spark, sf):
    """The words whose learnt vectors are most similar to that of one word."""
    learnt = word_vectors.learn(_lower_words(spark, sf))
    return similarity.recommend_by_vector(learnt.vectors.withColumnRenamed("word", "id"), WORD)


def recommend_learnt_vector_top5(spark, sf):
    """The five posts whose mean learnt word vectors are most similar to that of one post."""
    docs = _lower_words(spark, sf)
    means = stage(similarity.document_vectors(docs, stage(word_vectors.learn(docs).vectors)).where(F.col("vector").isNotNull()))
    return _attached(spark, sf, similarity.recommend_by_vector(means, TARGET))


def _all_weights(spark, sf):
    """All posts, copies too, with staged unit weights and vocabulary."""
    posts = fixtures.posts(spark, sf).select("id", terms(normalized_words(F.col("title")), lowercase=True).alias("terms"))
    docs = stage(posts)
    postings, vocabulary = pipelines.tfidf_tables(docs)
    return docs, stage(tfidf.weights(postings, vocabulary, docs=docs)), vocabulary


def similar_post_classes(spark, sf):
    """Posts with a cosine of 0.8 or more to another one: how many of these each has, and its class."""
    return similar_posts.similar_posts(*_all_weights(spark, sf))


def relevance_to_abstracts(spark, sf):
    """The ten posts most relevant to each item of the benchmark."""
    corpus = stage(pipelines.recommender_corpus(fixtures.posts(spark, sf), EXCLUDED).select("id", "terms"))
    postings, vocabulary = pipelines.tfidf_tables(corpus)
    weights = stage(tfidf.weights(postings, vocabulary, docs=corpus))
    items = fixtures.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("id"), terms(normalized_words(F.col("text")), lowercase=True).alias("terms"))
    asked = stage(relevance.query_weights(items, stage(relevance.bounded_vocabulary(weights, vocabulary))))
    return relevance.most_relevant(asked, weights)


def abstract_keywords(spark, sf):
    """The five key words of each item of the benchmark."""
    items = fixtures.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), normalized_words(F.col("text")).alias("words"))
    return keywords.keywords(items)


def spread_between_channels(spark, sf):
    """How often and how fast a text went from one channel to another."""
    posts = fixtures.posts(spark, sf).select("id", "url", F.col("subreddit").alias("channel"), F.col("created_utc").alias("at"))
    return spread.between_channels(spread.hops(posts))


# classification

def _labelled(spark, sf):
    return pipelines.labelled_corpus(fixtures.posts(spark, sf), "lang", CLASSES)


def _train_test(spark, sf):
    return pipelines.train_and_test(_labelled(spark, sf))


def _folds(spark, sf):
    train, _ = _train_test(spark, sf)
    return pipelines.folded(train)


def stratified_split(spark, sf):
    rows = stage(_labelled(spark, sf).select("id", "label"))
    return split.stratified_split(rows, "label")


def split_label_counts(spark, sf):
    return stratified_split(spark, sf).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


def stratified_folds(spark, sf):
    return _folds(spark, sf).select("id", "label", "fold")


def nb_model(spark, sf):
    train, _ = _train_test(spark, sf)
    return _rounded(bayes.fit(train).log_probabilities().drop("idf"), "logp", "prior")


def nb_predict(spark, sf):
    return pipelines.evaluated(*_train_test(spark, sf))


def _probabilities(spark, sf):
    train, test = _train_test(spark, sf)
    return bayes.predict_proba(test, bayes.fit(train)), test


def nb_predict_proba(spark, sf):
    probabilities, _ = _probabilities(spark, sf)
    return _rounded(probabilities.drop("odds"), "proba")


def accuracy(spark, sf):
    return _rounded(evaluate.accuracy(pipelines.evaluated(*_train_test(spark, sf))), "accuracy")


def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(pipelines.evaluated(*_train_test(spark, sf)), list(CLASSES))


def classification_report(spark, sf):
    predicted = stage(pipelines.evaluated(*_train_test(spark, sf)))
    report = evaluate.classification_report(predicted, list(CLASSES))
    return _rounded(report, "precision", "recall", "f1")


def roc_points(spark, sf):
    probabilities, test = _probabilities(spark, sf)
    points = evaluate.roc_points(stage(evaluate.score_counts(probabilities, test, by="odds")), by="odds")
    proba = F.when(F.col("threshold") == F.lit(float("inf")), F.col("threshold")).otherwise(1 / (1 + F.exp(-F.col("threshold"))))
    return _rounded(points.withColumn("threshold", proba), "threshold", "fpr", "tpr")


def roc_auc(spark, sf):
    probabilities, test = _probabilities(spark, sf)
    return _rounded(evaluate.roc_auc(evaluate.score_counts(probabilities, test, by="odds"), by="odds"), "auc")


SUMMARY = ("valid_avg", "train_avg", "valid_sd", "train_sd")


def cv_report(spark, sf):
    return _rounded(tuning.cross_validate(_folds(spark, sf)), *SUMMARY)


def tune_max_features(spark, sf):
    return _rounded(tuning.tune_one(_folds(spark, sf), max_features=tuning.SWEEP_MAX_FEATURES), *SUMMARY)


def tune_max_df(spark, sf):
    return _rounded(tuning.tune_one(_folds(spark, sf), max_df=tuning.SWEEP_MAX_DF), *SUMMARY)


def tune_min_df(spark, sf):
    return _rounded(tuning.tune_one(_folds(spark, sf), min_df=tuning.SWEEP_MIN_DF), *SUMMARY)


def tuning_curves(spark, sf):
    """A sweep in long form for a chart: training and validation accuracy per value."""
    swept = tune_min_df(spark, sf).where(F.col("metric") == "accuracy")
    return swept.select("metric", "param", "valid_avg", "train_avg").unpivot(
        ["metric", "param"], ["valid_avg", "train_avg"], "part", "score")


def grid_vocab(spark, sf):
    found = tuning.grid_search(_folds(spark, sf), tuning.vocabulary_grid())
    return _rounded(found, *SUMMARY)


def grid_alpha(spark, sf):
    choices = [tuning.Choice(PRUNED, a) for a in tuning.GRID_ALPHA]
    return _rounded(tuning.grid_search(_folds(spark, sf), choices), *SUMMARY)


def grid_unreachable(spark, sf):
    """A grid with a document frequency that no term reaches: its measures are NULL, its row stays."""
    return _rounded(tuning.grid_search(_folds(spark, sf), UNREACHABLE), *SUMMARY)


def _tuned(spark, sf):
    """Training and test rows, and the best parameters of both searches on the training rows."""
    train, test = _train_test(spark, sf)
    folds = pipelines.folded(train)
    grid = tuning.vocabulary_grid()
    rule = tuning.best_choice(tuning.grid_search(folds, grid), grid).rule
    alphas = [tuning.Choice(rule, a) for a in tuning.GRID_ALPHA]
    return train, test, tuning.best_choice(tuning.grid_search(folds, alphas), alphas)


def _languages(spark, sf):
    """Training and test posts of the four languages, and the two models' predictions and probabilities of the test posts."""
    return pipelines.train_and_test(pipelines.labelled_corpus(fixtures.posts(spark, sf), "lang", LANGUAGES))


def languages_bayes_report(spark, sf):
    """Naive Bayes of four classes on the test posts."""
    train, test = _languages(spark, sf)
    model = bayes.fit(train)
    predicted = test.select("id", "label").join(bayes.predict(test, model), "id")
    return _rounded(evaluate.classification_report(predicted, model.classes), "precision", "recall", "f1")


def languages_bayes_auc(spark, sf):
    """Area under the curve of each of four classes against the rest."""
    train, test = _languages(spark, sf)
    probabilities = bayes.predict_proba(test, bayes.fit(train))
    return _rounded(evaluate.roc_auc(evaluate.score_counts(probabilities, test, "odds"), by="odds"), "auc")


def languages_softmax_report(spark, sf):
    """Softmax regression of four classes on the test posts, from the stored model."""
    train, test = _languages(spark, sf)
    path = new_path(spark, "model")
    softmax.fit(train, VocabularyRule(min_df=3, max_features=2000), steps=12, tolerance=1e-3).save(path)
    model = bayes.NaiveBayesModel.load(spark, path)
    predicted = test.select("id", "label").join(bayes.predict(test, model), "id")
    return _rounded(evaluate.classification_report(predicted, model.classes), "precision", "recall", "f1")


def train_final(spark, sf):
    """The model of the best parameters: its terms, words' and class weights."""
    train, _, best = _tuned(spark, sf)
    model = bayes.fit(train, best.rule, best.alpha)
    return _rounded(model.log_probabilities().drop("prior"), "logp", "idf")


def final_confusion(spark, sf):
    return evaluate.confusion_matrix(pipelines.evaluated(*_tuned(spark, sf)), list(CLASSES))


def final_report(spark, sf):
    predicted = stage(pipelines.evaluated(*_tuned(spark, sf)))
    return _rounded(evaluate.classification_report(predicted, list(CLASSES)), "precision", "recall", "f1")


def final_roc_auc(spark, sf):
    train, test, best = _tuned(spark, sf)
    probabilities = bayes.predict_proba(test, bayes.fit(train, best.rule, best.alpha))
    return _rounded(evaluate.roc_auc(evaluate.score_counts(probabilities, test, by="odds"), by="odds"), "auc")


# projections and topics

def _weighted(spark, sf):
    corpus = stage(_labelled(spark, sf))
    return corpus.select("id", "label"), stage(tfidf.weights(*pipelines.tfidf_tables(corpus), docs=corpus))


def project_pca_2d(spark, sf):
    return _rounded(projection.pca_2d(*_weighted(spark, sf)), "pc1", "pc2")


def project_svd_2d(spark, sf):
    return _rounded(projection.svd_2d(*_weighted(spark, sf)), "sv1", "sv2")


def _topics(spark, sf):
    corpus = stage(_labelled(spark, sf))
    vectors, names = projection.tfidf_vectors(corpus, PRUNED)
    return topics.fit_topics(vectors), vectors, names


def lda_topics(spark, sf):
    model, vectors, _ = _topics(spark, sf)
    return topics.topic_of_posts(model, vectors)


def lda_top_words(spark, sf):
    model, _, names = _topics(spark, sf)
    return topics.top_words(model, names)


def topic_names(spark, sf):
    """The tag that the first word of each fitted topic points to."""
    docs = fixtures.posts(spark, sf).withColumn("words", normalized_words(F.col("title")))
    return topics.name_topics(lda_top_words(spark, sf), docs)


def tag_for_term(spark, sf):
    docs = fixtures.posts(spark, sf).withColumn("words", normalized_words(F.col("title")))
    return topics.tag_for_term(docs, "eau")


# streams, run to the end of what is there

def _finish(query) -> None:
    query.awaitTermination()


def stream_search(spark, sf):
    """Live search written to files, read back."""
    base = new_path(spark, "stream")
    arriving = fixtures.with_bodies(fixtures.posts_stream(spark, sf), spark, sf)
    found = feed.live_search(arriving, search.SearchSpec(subreddit="src0", keyword=KEYWORD))
    _finish(feed.write_feed(found, f"{base}/out", f"{base}/checkpoint"))
    return spark.read.schema(found.schema).parquet(f"{base}/out")


def stream_insert_if_absent(spark, sf):
    """The feed, delivered twice, inserted into a table that already holds the labelled posts."""
    run = uuid.uuid4().hex
    base = new_path(spark, "stream")
    columns = ["id", "author", "score", "created_utc", TAG]
    p = fixtures.posts(spark, sf).select(*columns).where(F.col(TAG).isNotNull())
    p.withColumn("updated_time", F.current_timestamp()).write.option("path", f"{base}/table").saveAsTable(f"feed_{run}")
    arriving = fixtures.posts_stream(spark, sf).select(*columns).withColumn("score", F.col("score") + 1000)
    for delivery in (1, 2):
        _finish(feed.ingest_feed(arriving, f"feed_{run}", f"{base}/checkpoint{delivery}"))
    spark.sql(f"DROP TABLE feed_{run}")  # the files stay until drop_staged
    return spark.read.parquet(f"{base}/table").drop("updated_time")


def stream_scores(spark, sf):
    """Classes predicted for arriving posts with a stored model."""
    base = new_path(spark, "stream")
    train, _ = _train_test(spark, sf)
    bayes.fit(train, PRUNED, TUNED.alpha).save(f"{base}/model")
    model = bayes.NaiveBayesModel.load(spark, f"{base}/model")
    arriving = fixtures.posts_stream(spark, sf)
    docs = arriving.select("id", terms(normalized_words(F.col("title")), lowercase=False).alias("terms"))
    _finish(feed.score_feed(docs, model, f"{base}/out", f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/out").drop("batch")


def _delivered(spark, sf, write, late: bool) -> str:
    """The folder a writer of windows fills while posts arrive in three parts by time, the writer ended and started again after each one.

    With ``late`` the last part also repeats some posts of the first one.
    """
    base = new_path(spark, "stream")
    posts = stage(fixtures.posts(spark, sf).select("id", "subreddit", "created_time", "created_utc", "num_comments", "score"))
    low, high = (x or 0 for x in posts.agg(F.min("created_utc"), F.max("created_utc")).first())
    part = F.when(F.lit(high == low), 0).otherwise(F.least(F.floor(3 * (F.col("created_utc") - low) / max(high - low, 1)), F.lit(2)))
    for k in range(3):
        of_part = posts.where(part == k)
        if late and k == 2:
            of_part = of_part.unionByName(posts.where((part == 0) & (F.col("id") % 10 == 0)))
        of_part.write.mode("append").parquet(f"{base}/inbox")
        arriving = spark.readStream.schema(posts.schema).parquet(f"{base}/inbox")
        _finish(write(activity.activity(arriving, tag="subreddit"), f"{base}/out", f"{base}/checkpoint"))
    return f"{base}/out"


def stream_keyed_set(spark, sf):
    """The last document set under each user id, kept up by a stream whose first part is delivered again after the last one."""
    base = new_path(spark, "stream")
    events = fixtures.table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    for part in (0, 1, 2, 0):
        events.where(F.pmod("event_id", F.lit(3)) == part).write.mode("append").parquet(f"{base}/inbox")
        arriving = spark.readStream.schema(events.schema).parquet(f"{base}/inbox")
        _finish(keyed.write_latest(arriving, f"{base}/table", f"{base}/checkpoint", "user_id", ("ts", "event_id")))
    return spark.read.parquet(f"{base}/table").select(*events.columns)


def _window_times(windows):
    return windows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def activity_closed(spark, sf):
    """Activity per channel and hour, of the hours that are closed; repeats of old posts are too late to count."""
    return _window_times(spark.read.parquet(_delivered(spark, sf, activity.write_closed, late=True)))


def activity_current(spark, sf):
    """Activity per channel and hour as of the last batch."""
    return _window_times(activity.current(spark, _delivered(spark, sf, activity.write_current, late=False)))


_ALL: tuple[Query, ...] = (
    search_posts, search_keyword_in_channel, scan_channel, scan_channel_two_tags,
    filter_time_range, filter_keyword, project_display, exclude_tag_null_safe,
    fill_missing_tag, epoch_and_time, count_by_tag, share_by_tag,
    posts_by_num_comments, posts_by_comments_tag, pivot_comments_by_tag, unpivot_comments_by_tag,
    distinct_authors, distinct_tags, duplicate_counts, dup_id_violations,
    dedupe_title_then_url, avg_words_by_tag, avg_words_overall, avg_words_normalized_by_tag,
    avg_posts_per_author_tag, authors_both_tags, authors_both_tags_top5, table_profile,
    thread_comment_stats, upsert_ignore, keyed_set_latest, normalize_titles,
    tfidf_weights, vocab_pruned, vocab_size, recommend_tfidf_top5,
    recommend_tfidf_for, doc_vectors_mean, recommend_vector_top5, recommend_words_vector_top5,
    stratified_split, split_label_counts, stratified_folds, nb_model,
    nb_predict, nb_predict_proba, accuracy, confusion_matrix,
    classification_report, roc_points, roc_auc, cv_report,
    tune_max_features, tune_max_df, tune_min_df, tuning_curves,
    grid_vocab, grid_alpha, grid_unreachable, train_final, final_confusion, final_report, final_roc_auc, project_pca_2d,
    project_svd_2d, lda_topics, lda_top_words, topic_names, tag_for_term,
    stream_search, stream_insert_if_absent, stream_scores,
    recommend_vector_indexed, similar_post_classes, relevance_to_abstracts, spread_between_channels,
    activity_closed, activity_current, stream_keyed_set, search_stored_posts, posts_on_busy_days, abstract_keywords,
    nested_comment_stats, languages_bayes_report, languages_bayes_auc, languages_softmax_report, word_cooccurrences, similar_words, recommend_learnt_vector_top5,
)


def registered() -> dict[str, Query]:
    """All queries by name."""
    return {query.__name__: query for query in _ALL}
