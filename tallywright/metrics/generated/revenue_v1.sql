SELECT location_id, CAST(sum(amount_minor) AS DOUBLE) AS value, count(*) AS observations FROM transactions WHERE organization_id = :organization GROUP BY location_id
