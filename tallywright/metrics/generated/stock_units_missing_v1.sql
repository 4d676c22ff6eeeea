SELECT location_id, CAST(sum(if(discrepancy > 0, discrepancy, 0)) AS DOUBLE) AS value, count(*) AS observations FROM stock_truth WHERE organization_id = :organization GROUP BY location_id
