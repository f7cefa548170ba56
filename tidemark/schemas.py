"""The relations of the engine, as schema strings that readers and writers take."""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "articles": "id string, headline string, summary string, content_hash string, source_name string, source_type string, url string, published_at timestamp, fetched_at timestamp, event_type string, sentiment_score double, urgency string, suggested_direction string, affected_sectors array<string>, affected_tickers array<string>, classification_summary string, importance_score double, embedding array<float>, raw_data map<string,string>, ipo_scanned_at timestamp, event_scanned_at timestamp, embed_attempts int, duplicate_of string, dedup_checked boolean, countries array<string>",
    "ticker_mentions": "ticker string, article_id string, sentiment_score double, urgency string, mentioned_at timestamp",
    "user_config": "key string, value string, updated_at timestamp",
    "sent_alerts": "article_id string, alert_type string, sent_at timestamp",
    "price_alerts": "ticker string, alert_date date",
    "llm_usage_log": "id bigint, timestamp timestamp, model_name string, operation string, prompt_tokens bigint, candidate_tokens bigint, total_tokens bigint, cost_usd double, latency_ms int, is_error int, error_message string, prompt_text string, response_text string",
    "predictions": "id string, ticker string, predicted_direction string, confidence double, horizon_days int, model_type string, feature_snapshot string, llm_narrative string, created_at timestamp, resolve_after date, actual_direction string, actual_change_pct double, is_correct int, resolved_at timestamp",
    "price_history": "ticker string, date date, open double, high double, low double, close double, volume bigint, fetched_at timestamp",
    "ticker_info": "ticker string, sector string, updated_at timestamp",
    "reflection_log": "id string, ticker string, prediction_id string, date date, lesson_learned string, was_successful boolean, scope string, sector string, tags array<string>",
    "predictions_cache": "ticker string, date date, advisory_json string",
    "conversations": "id string, title string, created_at timestamp, updated_at timestamp",
    "messages": "id string, conversation_id string, role string, content string, timestamp timestamp",
    "pipeline_metrics": "id bigint, recorded_at timestamp, cycle_duration_seconds double, fetched int, inserted int, embedded int, deduplicated int, classified int, ranked int, alerted int, failed int, llm_cost_estimate double",
    "sector_sentiment_snapshots": "id bigint, sector string, snapshot_time timestamp, avg_sentiment double, article_count bigint, bullish_count bigint, bearish_count bigint, neutral_count bigint, avg_importance double, top_tickers array<struct<ticker:string,count:bigint>>, sentiment_momentum double",
    "sector_rotation_signals": "id bigint, detected_at timestamp, from_sector string, to_sector string, signal_strength double, reasoning string, triggered_by string, is_active boolean, acknowledged boolean",
    "sector_daily_snapshot": "sector string, date date, mention_count bigint, avg_sentiment double, avg_importance double, bullish_ratio double, top_tickers array<string>",
    "hot_tickers": "ticker string, mention_count bigint, avg_sentiment double, sectors array<string>, rationale string, first_detected_at timestamp, last_detected_at timestamp",
    "ipo_tracker": "id string, company_name string, ticker string, ipo_date date, offering_price string, status string, sector string, estimated_valuation double, source_article_id string, notes string, detected_at timestamp, updated_at timestamp, metadata map<string,string>",
    "ticker_events": "id string, ticker string, event_type string, event_date date, event_title string, confidence string, source string, source_article_id string, notes string, created_at timestamp, updated_at timestamp",
    "trend_forecasts": "id string, ticker string, sector string, forecast_type string, scenario_label string, time_horizon string, confidence double, narrative string, key_drivers array<string>, supporting_evidence string, generated_at timestamp, expires_at timestamp, is_active boolean",
    "insider_transactions": "id string, ticker string, issuer_cik string, insider_name string, insider_title string, is_officer boolean, is_director boolean, is_ten_pct_owner boolean, transaction_date date, filed_at timestamp, transaction_code string, is_discretionary boolean, shares double, price_per_share double, value_usd double, shares_owned_after double, is_10b5_1 boolean, accession_no string, raw_data string",
    "institutional_stakes": "id string, ticker string, filer_name string, filer_cik string, form_type string, is_activist boolean, is_amendment boolean, pct_of_class double, shares double, event_date date, filed_at timestamp, accession_no string, raw_data string",
    "kr_investor_flows": "ticker string, trade_date date, inst_net double, foreign_net double, retail_net double, pension_net double, financial_inv_net double, trust_net double, total_value double, flow_unit string, source string",
}

#: What makes a row of a relation the same row; writers upsert or skip by it.
KEYS: dict[str, tuple[str, ...]] = {
    "articles": ("id",), "ticker_mentions": ("ticker", "article_id"), "user_config": ("key",), "sent_alerts": ("article_id", "alert_type"), "price_alerts": ("ticker", "alert_date"),
    "llm_usage_log": ("id",), "predictions": ("id",), "price_history": ("ticker", "date"), "ticker_info": ("ticker",), "reflection_log": ("id",), "predictions_cache": ("ticker", "date"),
    "conversations": ("id",), "messages": ("id",), "pipeline_metrics": ("id",), "sector_sentiment_snapshots": ("id",), "sector_rotation_signals": ("id",), "sector_daily_snapshot": ("sector", "date"),
    "hot_tickers": ("ticker",), "ipo_tracker": ("id",), "ticker_events": ("id",), "trend_forecasts": ("id",), "insider_transactions": ("id",), "institutional_stakes": ("id",), "kr_investor_flows": ("ticker", "trade_date"),
}
