"""Name -> plan registry used by ``__spark_entry__`` and ``bench.py``.

Every callable takes (spark, sf_dir) and reads the whole parquet tables under ``sf_dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from irforge.plans import feature_plans as fp, model_plans as mp, policy_plans as pp, selection, status_plans as stp, retrieval, sampling_plans as sp, textprep_plans as tpp, training_plans as trp, vector_plans as vp

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bm25_topk": retrieval.bm25_run,
    "containment_qrels": retrieval.qrels,
    "run_metrics": retrieval.run_metrics,
    "run_metrics_summary": retrieval.run_metrics_summary,
    "run_depth_report": retrieval.run_depth_report,
    "run_pool": retrieval.run_pool,
    "merge_title_text": tpp.merge_title_text,
    "filter_len_sampling": tpp.filter_len_sampling,
    "filter_len_kselect": tpp.filter_len_kselect,
    "truncate_tokens": tpp.truncate_tokens,
    "text_prefix": tpp.text_prefix,
    "clean_questions": tpp.clean_questions,
    "kept_questions": tpp.kept_questions,
    "clean_llm_output": tpp.clean_llm_output,
    "extract_question": tpp.extract_question,
    "render_fewshot_prompt": tpp.render_fewshot_prompt,
    "render_template_prompt": tpp.render_template_prompt,
    "doc_text_join_fields": tpp.doc_text_join_fields,
    "unit_normalize": vp.unit_normalize,
    "neighbor_counts": vp.neighbor_counts,
    "cluster_sizes": vp.cluster_sizes,
    "cluster_means": vp.cluster_means,
    "nearest_centroid": vp.nearest_centroid,
    "medoid_per_cluster": vp.medoid_per_cluster,
    "nearest_cluster": vp.nearest_cluster,
    "cosine_sse": vp.cosine_sse,
    "dense_topk": vp.dense_topk,
    "masked_mean_pool": vp.masked_mean_pool,
    "silhouette_by_label": vp.silhouette_by_label,
    "knee_of_curve": vp.knee_of_curve,
    "sse_curve_kmeans": vp.sse_curve_kmeans,
    "auto_select_k": vp.auto_select_k,
    "kmeans_assign": vp.kmeans_assign,
    "docs_with_embeddings": fp.docs_with_embeddings_q,
    "tfidf_weights": fp.tfidf_weights,
    "top_terms": fp.top_terms,
    "tfidf_density": fp.tfidf_density,
    "lexical_redundancy": fp.lexical_redundancy,
    "corpus_stats": fp.corpus_stats,
    "expert_scores": fp.expert_scores,
    "cluster_zscore": fp.cluster_zscore,
    "blended_score": fp.blended_score,
    "cluster_best_doc": fp.cluster_best_doc,
    "cluster_quota": fp.cluster_quota,
    "cluster_schedule": fp.cluster_schedule,
    "tail_negatives": trp.tail_negatives,
    "rerank_train": trp.rerank_train,
    "triples": trp.triples,
    "reranker_inputs": trp.reranker_inputs,
    "rerank_testset": trp.rerank_testset,
    "explode_testdata": trp.explode_testdata,
    "rerank_scores": trp.rerank_scores,
    "rerank_metrics": trp.rerank_metrics,
    "predictions_map": trp.predictions_map,
    "sample_size_per_cluster": sp.sample_size_per_cluster,
    "cluster_softmax": sp.cluster_softmax,
    "weighted_sample_pool": sp.weighted_sample_pool,
    "sample_documents": sp.sample_documents,
    "replay_steps": pp.replay_steps,
    "policy_replay_ema": pp.policy_replay_ema,
    "policy_replay_critic": pp.policy_replay_critic,
    "reward_curve": pp.reward_curve,
    "rank_reward": pp.rank_reward,
    "discriminative_reward": pp.discriminative_reward,
    "answer_reward": pp.answer_reward,
    "coverage_reward": pp.coverage_reward,
    "dynamic_dup_threshold": pp.dynamic_dup_threshold,
    "run_stats": pp.run_stats,
    "stream_progress": pp.stream_progress,
    "answer_snippet": mp.answer_snippet,
    "generate_candidates": mp.generate_candidates,
    "embed_documents": mp.embed_documents,
    "ivf_topk": mp.ivf_topk,
    "late_interaction": mp.late_interaction,
    "selection_rounds": selection.selection_rounds,
    "best_candidate": selection.best_candidate,
    "dataset_counts": stp.dataset_counts,
    "completeness_check": stp.completeness_check,
    "artifact_coverage": stp.artifact_coverage,
    "zip_positional": stp.zip_positional,
    "candidate_k_grid": stp.candidate_k_grid,
    "exemplar_sample": mp.exemplar_sample,
    "question_dup_edges": pp.question_dup_edges,
    "semantic_dedup": pp.semantic_dedup,
    "sorted_selected": pp.sorted_selected,
}
