"""Time one registered query: python tests/llm/run_one.py NAME [sf_dir]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

if __name__ == "__main__":
    from kohort.session import get_spark
    import __spark_entry__ as E
    spark = get_spark("local[8]", shuffle_partitions=16, extra={"spark.driver.memory": "8g"})
    sf = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"
    t0 = time.time()
    df = E.queries()[sys.argv[1]](spark, sf)
    df.show(8, truncate=40)
    print("rows", df.count(), "seconds", round(time.time() - t0, 1))
    spark.stop()
