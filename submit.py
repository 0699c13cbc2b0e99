"""Entry script for spark-submit: ``spark-submit --py-files cohortlens.zip submit.py run ...``"""

from cohortlens.__main__ import main

if __name__ == "__main__":
    main()
