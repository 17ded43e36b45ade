import sys

from glyphflow.app import main

sys.exit(main())
