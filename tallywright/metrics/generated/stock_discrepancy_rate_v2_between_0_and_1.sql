SELECT * FROM (SELECT location_id, CAST(count_if(abs(discrepancy) > 0) / nullif(count(*), 0) AS DOUBLE) AS value, count(*) AS observations FROM stock_truth WHERE organization_id = :organization GROUP BY location_id) WHERE value < 0 OR value > 1
