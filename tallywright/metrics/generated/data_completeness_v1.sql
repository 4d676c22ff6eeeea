SELECT source_key, CAST(sum(accepted_records) / nullif(sum(total_records), 0) AS DOUBLE) AS value, count(*) AS observations FROM data_quality WHERE organization_id = :organization GROUP BY source_key
