SELECT location_id, CAST(count_if(abs(discrepancy) > 20) / nullif(count(*), 0) AS DOUBLE) AS value, count(*) AS observations FROM stock_truth WHERE organization_id = :organization GROUP BY location_id
